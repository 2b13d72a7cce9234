"""The default routing: which files are measured how, by extension."""

#: Module, file filters, tags and options of each entry; the verb is measure.
DEFAULT_ENTRIES = r"""
Code *.py;*.pyd;*.pyw;*.ipynb python code OPT:PYTHON_TRIPLE_COMMENTS
Code *.sh;*.bat;*.cmd;*.ps1;NO_EXT shell code
Code *.c c code definition
Code *.h c code declaration
Code *.cpp;*.cc;*.cxx c++ code definition
Code *.hpp;*.hxx;*.hh c++ code declaration
Code *.java java code java
Code *.cs csharp code .net
Code *.go go code
Code *.rs rust code
Code *.js;*.mjs javascript code
Code *.ts typescript code
Web *.htm;*.html html code
Web *.vue vue code
Code *.jsx;*.tsx react code
Code *.dart dart code
Code *.swift swift code
Code *.kt;*.ktm;*.kts kotlin code
Code *.tf terrform code
NBNC *.yml;*.yaml yaml other
Code *.m;*.mm objectivec code
Code *.scala scala code
Code *.clj;*.cljs clojure code
Code *.sql;*.ddl;*.tbl;*.tab sql code
Code *.pkg;*.pkb;*.pks;*.pls;*.pck sql code
Code *.sp;*.prc;*.proc; sql code
Code *.trg;*.viw;*.view sql code
Web *.php;*.php?;*.cgi;*.inc php code
Code *.rb;*.rjs;*.rabl;*.erb;*.rake ruby code
Code *.pl;*.pm;*.ps;*.t perl code
Code *.css css code
Code *.less;*.scss;*.sass;*.styl css code
Web *.cshtml;*.vbhtml razor code .net
Code *.mustache mustache code
Web *.rhtml ruby code
Web *.jsp;*.tld jsp code java
Code *.js2 jinja2 code ansible
Web *.as?x aspx code .net
Web *.xaml xaml other .net
Code *.jade jade code
Code *.haml haml code
Web *.ejs ejs code
Code *.pp puppet code
Web *.esp;*.esj esp code
Web *.xhtml;*.htc html code
Code *.f;*.ftn;*.for;*.f77;*.f90 fortran code
Code *.r r code math
Code *.wl;*.nb matlab code math
Code *.d d code
Code *.lua lua code
Code *.groovy groovy code
Code *.coffee coffee code
Code *.erl erlang code
Code *.scm;*.sch;*.ss scheme code
Code *.rkt racket code
Code *.lsp;*.lisp;*.cl;*.el lisp code
Code *.hs haskel code
Code *.e;*.eiffel eiffel code
Code *.hx haxe code
Code *.ex;*.exs elxir code
Code *.elm elm code
Code *.mak;*.*proj build code
Code *.tcl tcl code
Code *.asm;*.s asm code
Code *.fsx fsharp code .net
Code *.sol solidity code
Code *.as;*.mxml flex code
Web *.tml tapestry code
Code *.xsl;*.xslt xsl code
Code *.aj aspectjava code
Code *.awk awk code
Code *.l;*.lex;*.y;*.yrl;*.g parsing code
Code *.cls;*.page;*.tab;*.trigger apex code
Code *.workflow;*.object;*.component apex code OPT:BLANK_LINE_XML
Code *.vbs;*.vba vba code
Code *.cfc coldfusion code
Code *.ada;*.ads;*.adb ada code
Code *.cla;*.cln;*.txd;*.txa clarion code
Web *.cfm coldfusion code
Web *.asp asp code
Code *.v;*.vh;*.sv;*.vhd hardware code
Code *.vlib;*.vpp hardware code
Code *.nsh;*.ism;*.wse;*.rul install code
Code *.rpg rpg code OPT:COMMENT_LINE:(......[\*])
Code *.vb vb.net code .net OPT:COMMENT_LINE:[']+(?![^']+'\s*$) OPT:MACHINE_ADD_DETECT:[re.compile(r'Sub\s+InitializeComponent'),re.compile(r'End\s+Sub')]
customDelphi *.pas delphi code
customCobol *.cob;*.cbl;*.cobol cobol code
NBNC *.json json other
NBNC *.xml;*.xsd;*.xss;*.xsc;*.xsx xml other OPT:BLANK_LINE_XML
NBNC *.ashx;*.asmx;*.resx resource other .net
NBNC *.proto protobuf other
NBNC *.po perl other
NBNC *.dsp;*.sln build other
NBNC *.properties;*.config;*.policy config other
NBNC *.res;*.str;*.xib resource other
NBNC *.rdl;*.rdlc;*.rpt report other
NBNC *.wsdl;*.idl;*.rpc;*.ridl interface other
NBNC *.bpel bpel other
customDelphi *.dfm delphi other
"""


def _entry(line: str) -> str:
    module, files, *more = line.split()
    measures = "file.*" if module == "NBNC" else "*"
    return " ".join(["measure", module, measures, files, *more])


DEFAULT_CONFIG = "\n".join(_entry(x) for x in DEFAULT_ENTRIES.strip().splitlines())
