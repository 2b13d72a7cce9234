"""Secret scans over a trigram inverted index, in DataFrame functions alone.

The index holds, for each trigram that some rule's query names, the keys of
the texts whose lower-cased form contains it. Evaluating the rules' Boolean
queries on the postings of a key gives the candidate (text, rule) pairs; only
those are searched by regular expression. Rules without a mandatory trigram
have every text as candidate. A key is the 64-bit hash of a text: equal texts
share their postings, and should two texts collide, the candidates of either
are searched in both, so no match is lost.

Texts stay where they are: the candidates' keys are broadcast, up to
``BROADCAST_KEYS`` of them. Beyond it, texts that have a posting are shuffled
to meet them, the copies of one text in ``SALTS`` parts.

Matches are leftmost and non-overlapping per rule, those whose length group is
too short are dropped, and offsets count code points. Offsets are sums over
blocks of matches, so a text of very many matches isn't quadratic. A null text
has no match. Rows pass through one by one: repeated rows and keys are kept,
extra columns as well, whatever their names, but for those named like a kind,
which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import checkpoint, columns_of, whole
from textloom.llm.trigrams import grams, query_of, thinned

#: Candidate keys (8 bytes, and one a rule) up to which they are broadcast, and parts of a key's texts beyond it.
BROADCAST_KEYS, SALTS = 1_000_000, 16
#: Trigrams that share one long as bits.
_BITS = 62


@dataclass(frozen=True)
class Secret:
    """``group`` of a match must have ``least`` characters. The pattern has no groups but those."""

    kind: str
    regex: str
    group: int
    least: int


#: Kinds and patterns of the base scan, in the order that breaks ties. A run of
#: one class is found whole or not at all, so the last two have their length in the pattern; a
#: short match of the first hides what it covers, so it is found first and dropped afterwards.
BASE = (
    Secret("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Secret("access", r"(AKIA[A-Z0-9]{14,})", 1, 18),
    Secret("hex", r"([0-9a-f]{16,})", 1, 16),
)


#: Formats of keys and tokens that their issuers have published.
MORE = (
    Secret("private_key", r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----)", 1, 1),
    Secret("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1),
    Secret("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 1),
    Secret("gitlab", r"(glpat-[A-Za-z0-9_-]{20,})", 1, 1),
    Secret("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 1),
    Secret("stripe", r"((?:sk|rk)_live_[A-Za-z0-9]{16,})", 1, 1),
    Secret("google", r"(AIza[A-Za-z0-9_-]{35})", 1, 1),
    Secret("npm", r"(npm_[A-Za-z0-9]{36})", 1, 1),
    Secret("sendgrid", r"(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})", 1, 1),
    Secret("temporary", r"(ASIA[A-Z0-9]{16})", 1, 1),
    Secret("bearer", r"((?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*)", 1, 1),
    Secret("connection", r"((?i:postgres|postgresql|mysql|mongodb|redis|amqp|mssql)(?:\+[a-z]+)?://[^\x20\x09-\x0D:/@]*:[^\x20\x09-\x0D:/@]+@)", 1, 1),
)
RULES = BASE + MORE


def _query(rule: Secret):
    return thinned(query_of(rule.regex))


def _narrow(rules: tuple[Secret, ...]) -> list[Secret]:
    """The rules with a mandatory trigram."""
    return [r for r in rules if _query(r) is not True]


def _vocabulary(rules: tuple[Secret, ...]) -> list[str]:
    return sorted(set().union(*(grams(_query(r)) for r in rules)))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _found(low: Column, vocabulary: list[str]) -> Column:
    """Places in the vocabulary of the trigrams that the lower-cased text holds."""
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(vocabulary))).cast("array<int>"))


def build_index(docs: DataFrame, rules: tuple[Secret, ...] = RULES, text: str = "text") -> DataFrame:
    """Postings (gram, key) of the trigrams that the rules' queries name."""
    vocabulary = _vocabulary(rules)
    # The lower-cased text is a column of its own, and explode() would put the whole test into a filter besides: each is done once.
    df = docs.select(text_key(F.col(text)).alias("key"), F.lower(F.col(text)).alias("_low")).select("key", _found(F.col("_low"), vocabulary).alias("_found"))
    names = F.array(*(F.lit(g) for g in vocabulary)).cast("array<string>")
    return df.select("key", F.explode_outer("_found").alias("_i")).filter("_i is not null").select(F.get(names, F.col("_i")).alias("gram"), "key")


def _holds(query, place: dict[str, int]) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        word, bit = divmod(place[query], _BITS)
        return F.col(f"_w{word}").bitwiseAND(F.lit(1 << bit)) != 0
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, (_holds(p, place) for p in query[1]))


def candidates(index: DataFrame, rules: tuple[Secret, ...] = RULES) -> DataFrame:
    """Key and due: for each rule with a mandatory trigram whether the key's postings fulfil its query."""
    place = {g: i for i, g in enumerate(_vocabulary(rules))}

    def word(w: int) -> Column:
        bits = F.create_map(*(F.lit(x) for g, i in place.items() if i // _BITS == w for x in (g, 1 << i % _BITS)))
        return F.bit_or(F.coalesce(bits[F.col("gram")].cast("long"), F.lit(0).cast("long")))

    # The words of a key's bits are or-ed before the shuffle, so a key of many texts is one row a task.
    met = index.groupBy("key").agg(*(word(w).alias(f"_w{w}") for w in sorted({i // _BITS for i in place.values()})))
    # One column for all rules: the planner derives constraints from every alias that a filter sees.
    met = met.select("key", F.array(*(_holds(_query(r), place) for r in _narrow(rules))).cast("array<boolean>").alias("due"))
    return met.filter(F.array_contains("due", True))


def _pieces(text: Column, rule: Secret) -> Column:
    """Lengths of the gap before each match and of the match, and whether it is kept.

    \\G ties every piece to the end of the one before, so the lengths add up to offsets.
    """
    piece = r"\G((?s:.*?))(" + rule.regex + ")"
    whole_, match = (F.regexp_extract_all(text, F.lit(piece), F.lit(i)) for i in (0, 2))
    long_enough = [F.regexp_extract_all(text, F.lit(piece), F.lit(rule.group + 2)).alias("p")] if rule.least > 1 else []

    def of(x: Column) -> Column:
        ok = F.length(x["p"]) >= rule.least if long_enough else F.lit(True)
        return F.struct((F.length(x["w"]) - F.length(x["m"])).alias("gap"), F.length(x["m"]).alias("size"), ok.alias("ok"))

    return F.transform(F.arrays_zip(whole_.alias("w"), match.alias("m"), *long_enough), of)


def _blocks(pieces: Column) -> Column:
    """Blocks of sqrt(n) of the n pieces."""
    wide = F.ceil(F.sqrt(F.size(pieces))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(pieces) - 1, wide), lambda i: F.slice(pieces, i + 1, wide))


def _spans(blocks: Column) -> Column:
    """Array of (start, end) of the kept matches: blocks are added up first, then each block's own pieces."""
    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(sizes, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def step(acc: Column, x: Column) -> Column:
        begins = acc["at"] + x["gap"]
        ends = begins + x["size"]
        one = F.array(F.struct(begins.alias("start"), ends.alias("end")))
        return F.struct(ends.alias("at"), F.when(x["ok"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def of(z: Column) -> Column:
        none = F.struct(z["s"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        return F.aggregate(z["b"], none, step)["out"]

    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("s")), of))


def _with_candidates(docs: DataFrame, rules: tuple[Secret, ...], text: str) -> DataFrame:
    """(_in, due), due null where the row is no candidate at all."""
    found = checkpoint(candidates(build_index(docs, rules, text), rules)).withColumnRenamed("key", "_key")
    rows = docs.select(whole(docs).alias("_in")).select("_in", text_key(F.col("_in").getField(text)).alias("_key"))
    if found.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(found), "_key", "left").drop("_key")
    rows = rows.withColumns({"_salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"), "_low": F.lower(F.col("_in").getField(text))})
    rows = rows.select("_in", "_key", "_salt", F.coalesce(F.size(_found(F.col("_low"), _vocabulary(rules))) > 0, F.lit(False)).alias("_listed"))
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.filter("_listed").join(salted, ["_key", "_salt"], "left")
    return met.unionByName(rows.filter("not _listed"), allowMissingColumns=True).drop("_key", "_salt", "_listed")


def scan(docs: DataFrame, rules: tuple[Secret, ...] = RULES, text: str = "text") -> DataFrame:
    """Add an array of (start, end) for each rule, in a column named by its kind."""
    narrow = [r.kind for r in _narrow(rules)]
    df = _with_candidates(docs, rules, text) if narrow else docs.select(whole(docs).alias("_in"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    body = F.coalesce(F.col("_in").getField(text), F.lit(""))
    due = {r.kind: F.coalesce(F.get("due", F.lit(narrow.index(r.kind))), F.lit(False)) if r.kind in narrow else F.lit(True) for r in rules}
    # A column a step, null where the rule has no match: none is computed twice.
    df = df.select("_in", *(F.when(due[r.kind] & body.rlike(r.regex), _pieces(body, r)).alias(f"_{r.kind}") for r in rules))
    df = df.select("_in", *(F.when(F.col(f"_{r.kind}").isNotNull(), _blocks(F.col(f"_{r.kind}"))).alias(f"_{r.kind}") for r in rules))
    df = df.select("_in", F.struct(*(F.when(F.col(f"_{r.kind}").isNotNull(), _spans(F.col(f"_{r.kind}"))).otherwise(none).alias(r.kind) for r in rules)).alias("_spans"))
    return df.select(*columns_of(docs, but=tuple(r.kind for r in rules)), *(F.col("_spans").getField(r.kind).alias(r.kind) for r in rules))


def listed(rules: tuple[Secret, ...] = RULES) -> Column:
    """kind:start:end of all spans, by start and then by the order of the rules."""

    def placed(kind: str, i: int) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    every = F.concat(*(placed(r.kind, i) for i, r in enumerate(rules)))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    df = scan(docs.select("doc_id", "text"))
    return df.select("doc_id", *(F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE), F.sha2(listed(BASE), 256).alias("base_sha256"), listed().alias("spans"))
