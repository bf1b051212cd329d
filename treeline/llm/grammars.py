"""Productions of the languages whose files are checked, in the notation of ``automata``.

Inside one pair of brackets the syntax of these languages is regular but for two things: statements
nested without brackets, which become prefixes here, and type arguments in angle brackets, which are
written out to a fixed depth. Where a language's syntax depends on context a production accepts more.
"""

from __future__ import annotations

from functools import cache

from treeline.llm.automata import Grammar

# ---------------------------------------------------------------- json


@cache
def json() -> Grammar:
    value = "( STR | NUM | true | false | null | C:obj | B:arr )"
    return Grammar("true false null", "{ } [ ] , :", "STR NUM", {}, {"value": value}, {"F:file": "@value", "C:obj": "( STR ': @value ( ', STR ': @value )* )?", "B:arr": "( @value ( ', @value )* )?"})


# ---------------------------------------------------------------- toml


@cache
def toml() -> Grammar:
    rules = {
        "key": "( KEY | STR ) ( DOTTED | '. ( KEY | STR )? )*",
        "value": "( STR | MSTR | VALUE | B:arr | C:table )",
        "pair": "@key '= @value",
    }
    kinds = {
        "F:file": "( ( @pair | B:head )? NL )* ( @pair | B:head )?", "B:arr": "( @value ( ', @value )* ','? )?".replace("','?", "( ', )?"), "B:head": "( @key | B:head )",
        "C:table": "( @pair ( ', @pair )* )?",
    }
    return Grammar("", "{ } [ ] , . =", "STR MSTR K V KV DOTTED NL", {"KEY": "K KV", "VALUE": "V KV"}, rules, kinds)


# ---------------------------------------------------------------- javascript and typescript

_JS_WORDS = (
    "async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new null of return set static super "
    "switch this throw true false try typeof undefined var void while with yield as accessor enum"
)
_TS_WORDS = "abstract any asserts declare implements infer interface is keyof module namespace override private protected public readonly satisfies type unique global out"
_JS_MARKS = "{ } ( ) [ ] ${ }$ ; , . ... ?. ? : = => ! @ # * < > ++ -- ~ + - & |"


@cache
def javascript(types: bool = False) -> Grammar:
    loose = "async from get of set as accessor undefined let"
    words = _JS_WORDS + (" " + _TS_WORDS if types else "")
    sets = {
        "ID": "NAME " + loose + (" " + _TS_WORDS if types else ""), "PROP": "NAME *WORDS", "BIN": "BINOP * < > & | + - = in instanceof", "UNARY": "UNOP ! ~ + - ++ -- typeof void delete await",
        "MOD": "async get set static accessor" + (" public private protected readonly abstract declare override" if types else ""), "SEMI": "; ASI", "DECL": "let var", "SIGN": "+ -",
        "FIX": "++ --", "RESTRICTED": "++ --",
    }
    r: dict[str, str] = {}
    ts = (lambda x: x) if types else (lambda x: "")
    if types:
        r["targs"] = "'< @type ( ', @type )* ( ', )? '>"
        r["tparams"] = "'< ( ( const | in | out )* ID ( extends @type )? ( '= @type )? ( ', )? )* '>"
        core = "( ( ID | this | typeof ( ID | this ) | import P:args ) ( '. ( PROP | PRIV ) )* @targs? | STR | NUM | SIGN NUM | TPL | TPLHEAD T:type ( TPLMID T:type )* TPLEND | null | true | false | void | undefined | const | P:type | C:tobj | B:tuple )"
        head = "( keyof | unique | readonly | infer | asserts | abstract | new | @tparams? P:params '=> | ID is | this is )"
        r["type"] = f"( '| | '& )? {head}* {core} ( B:empty,type )* ( ( '| | '& | extends | Q:type ) {head}* {core} ( B:empty,type )* )*"
        r["ann"] = "': @type"
    r["opt"] = "( OPT | '! )?" if types else ""
    r["ann?"] = ts("( @ann )?")
    ann = ts("( @ann )?")
    r["bind"] = "( ID | yield | await | B:array | C:object )"
    r["heads"] = f"async? ( {ts('@tparams?')} P:params {ann} | ID ) '=>"
    r["func"] = f"async? function ( '* )? ( ID | yield | await )? {ts('@tparams?')} P:params {ann}"
    r["deco"] = "( '@ ( ID ( '. PROP )* | P:exprs ) ( P:args )? )*"
    r["class"] = f"class ( ID )? {ts('@tparams?')} ( extends @lhs {ts('@targs?')} )? {ts('( implements @type ( COMMA @type )* )?')} C:class".replace("COMMA", "',")
    r["lhs"] = "( ID | this | P:exprs | null | C:object ) ( ( '. | '?. ) PROP | P:args | B:exprs )*"
    r["template"] = "( TPL | TPLHEAD T:exprs ( TPLMID T:exprs )* TPLEND )"
    r["primary"] = f"( ID | NUM | STR | REGEX | this | super | null | true | false | import | yield | @template | PRIV | P:exprs | B:array | C:object | @func C:block | @deco {ts('abstract?')} @class | @heads C:block | new '. ID )"
    r["post"] = f"( ( '. | '?. ) ( PROP | PRIV ) | ( '?. )? P:args | ( '?. )? B:exprs | @template | FIX {ts(chr(124) + ' (' + ' as | satisfies ) @type | ' + chr(39) + '! | @targs')} )"
    r["named"] = r["func"].replace("( ID | yield | await )?", "( ID | yield | await )")
    r["namedclass"] = r["class"].replace("class ( ID )?", "class ID")
    r["first"] = r["primary"].replace("| C:object ", "").replace("| @func C:block ", "").replace(f"| @deco {ts('abstract?')} @class ", "")
    prefix = f"( UNARY | new | yield ( '* )? | @heads {ts('| @targs')} )*"
    operand = f"{prefix} @primary @post*"
    r["expr"] = f"{operand} ( ( BIN | '> '> ( '> )? | Q:expr ) {operand} )*"
    r["exprs"] = "@expr ( ', @expr )*"
    some = prefix[:-1] + "+"
    r["exprstmt"] = f"( {some} @primary | @first ) @post* ( ( BIN | '> '> ( '> )? | Q:expr ) {operand} )* ( ', @expr )*"
    r["var"] = f"( const @bind {ts(chr(39) + '!?'.replace('?', '')) and ''} {ann} '= @expr ( ', @bind {ann} '= @expr )* | DECL @bind {ts('( ! )?'.replace('!', chr(39) + '!'))} {ann} ( '= @expr )? ( ', @bind {ts('( ! )?'.replace('!', chr(39) + '!'))} {ann} ( '= @expr )? )* )"
    r["prefix"] = "( for await? P:for | while P:exprs | with P:exprs | do | ID ': )"
    r["core"] = (
        "( C:block | '; | @var SEMI | @exprstmt SEMI | return @exprs? SEMI | throw @exprs SEMI | break ( ID )? SEMI | continue ( ID )? SEMI | debugger SEMI | @named C:block | @deco "
        + ts("abstract? ") + "@namedclass | try C:block ( catch ( P:params )? C:block ( finally C:block )? | finally C:block ) | switch P:exprs C:cases "
        + ts("| @decls | @named SEMI ") + ")"
    )
    if types:
        r["decls"] = (
            "( declare | abstract )* ( interface ID @tparams? ( extends @type ( ', @type )* )? C:tobj | type ID @tparams? '= @type SEMI | const? enum ID C:enum | ( namespace | module ) ( ID ( '. ID )* | STR ) C:module | module STR SEMI | global C:module "
            "| declare ( const | let | var ) @bind ( @ann )? ( '= @expr )? ( ', @bind ( @ann )? ( '= @expr )? )* SEMI | declare @func SEMI | declare @deco abstract? @class )"
        )
    r["stmt"] = "( @prefix* @core | ( @prefix | if P:exprs )* if P:exprs @prefix* @core ( else ( @prefix | if P:exprs )* @core )* )"
    r["import"] = f"import ( STR | {ts('type?')} ( ID ( ', ( C:specs | '* as ID ) )? | C:specs | '* as ID ) from STR ) ( with C:object )? SEMI" + ts(" | import ID '= ( ID P:args | ID ( '. ID )* ) SEMI")
    r["export"] = (
        f"@deco export ( default ( @exprs SEMI | @func C:block | @deco {ts('abstract?')} @class {ts('| interface ID C:tobj | @func SEMI')} ) | {ts('type?')} C:specs ( from STR ( with C:object )? )? SEMI | {ts('type?')} '* ( as ( PROP | STR ) )? from STR SEMI "
        f"| @var SEMI | @named C:block | @deco {ts('abstract?')} @namedclass {ts('| @decls | @func SEMI | ' + chr(39) + '= @exprs SEMI | as namespace ID SEMI | import ID ' + chr(39) + '= @exprs SEMI')} )"
    )
    name = "( PROP | STR | NUM | B:exprs,expr | PRIV )"
    member = f"MOD* ( '* )? {name} ( @opt {ts('@tparams?')} P:params {ann} ( C:block {ts('| SEMI')} ) | @opt {ann} ( '= @expr )? SEMI )"
    module = "( @stmt | @import | @export )*"
    kinds = {
        "F:file": f"SHEBANG? {module}", "C:block": "( @stmt )*", "C:module": f"( @stmt | @import | @export {ts('| export? const @bind @ann ( QQ, @bind @ann )* SEMI')} )*".replace("QQ", "'"), "C:cases": "( ( case @exprs ': | default ': ) @stmt* )*",
        "C:class": f"( '; | @deco ( static C:block | {member} {ts('| MOD* B:index @ann SEMI')} ) )*",
        "C:object": f"( ( '... @expr | ID ( '= @expr )? | await | yield | {name} ': @expr | ( async | get | set )* ( '* )? {name} {ts('@tparams?')} P:params {ann} C:block ) ( ', | END ) )*".replace("( ', | END ) )*", "( ', ( '... @expr | ID ( '= @expr )? | await | yield | %s ': @expr | ( async | get | set )* ( '* )? %s %s P:params %s C:block ) )* ( ', )? )?" % (name, name, ts('@tparams?'), ann)),
        "C:specs": f"( {ts('type?')} ( PROP | STR ) ( as ( PROP | STR ) )? ( ', {ts('type?')} ( PROP | STR ) ( as ( PROP | STR ) )? )* ( ', )? )?",
        "B:array": "( ', )* ( ( @expr | '... @expr ) ( ', )* )*".replace("( ( @expr | '... @expr ) ( ', )* )*", "( ( '... )? @expr ( ( ', )+ ( '... )? @expr )* ( ', )* )?"),
        "B:exprs": "@exprs", "B:expr": "@expr", "P:exprs": "@exprs", "T:exprs": "@exprs", "Q:expr": "@expr",
        "P:args": "( ( '... )? @expr ( ', ( '... )? @expr )* ( ', )? )?",
        "P:params": f"( @deco MOD* ( '... )? ( @bind | this ) @opt {ann} ( '= @expr )? ( ', @deco MOD* ( '... )? ( @bind | this ) @opt {ann} ( '= @expr )? )* ( ', )? )?",
        "P:for": f"( ( const | DECL ) @bind {ann} ( of @expr | in @exprs ) | @lhs ( of @expr | in @exprs ) | ( B:array | C:object ) ( of | in ) @exprs | ( @var | @exprs )? '; @exprs? '; @exprs? )",
    }
    if types:
        tname = "( PROP | STR | NUM | B:expr,exprs | PRIV )"
        kinds |= {
            "B:empty": "", "B:type": "@type", "T:type": "@type", "Q:type": "@type", "P:type": "@type", "B:tuple": "( ( '... )? ( ID ( OPT )? ': )? ( '... )? @type ( OPT )? ( ', ( '... )? ( ID ( OPT )? ': )? ( '... )? @type ( OPT )? )* ( ', )? )?", "B:index": "ID ': @type",
            "B:mapped": "ID in @type ( as @type )?", "C:enum": "( ( PROP | STR | B:expr ) ( '= @expr )? ( ', ( PROP | STR | B:expr ) ( '= @expr )? )* ( ', )? )?",
            "C:tobj": f"( ( SIGN? readonly )? B:mapped ( SIGN? OPT )? ( @ann )? ( SEMI )? | ( '; )* ( ( MOD* {tname} ( OPT )? ( @ann )? | MOD* {tname} ( OPT )? @tparams? P:params ( @ann )? | @tparams? P:params ( @ann )? | new @tparams? P:params ( @ann )? | readonly? B:index ( OPT )? @ann ) ( SEMI | ', ) ( '; )* )* )",
        }
    r.pop("ann?", None)
    return Grammar(words, _JS_MARKS, "NAME NUM STR REGEX TPL TPLHEAD TPLMID TPLEND PRIV BINOP UNOP OPT SHEBANG", sets, r, kinds, line_ends=True)


# ---------------------------------------------------------------- go

_GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"


@cache
def go() -> Grammar:
    r = {
        "pre": "( '* | B:empty,exprs,dots | map B:exprs | chan | '<- chan | chan '<- )",
        "tcore": "( NAME ( '. NAME )? ( B:exprs )? | func P:params @result? | struct C:struct | interface C:iface | P:exprs )",
        "type": "@pre* @tcore",
        "result": "( @type | P:params )",
        "primary": "( NAME | NUM | STR | P:exprs | func P:params @result? C:block | @pre+ @tcore ( C:lit )? | struct C:struct ( C:lit )? | interface C:iface | func P:params @result? )",
        "post": "( '. NAME | '. P:exprs,typeword | P:args | B:exprs,slice | C:lit )",
        "expr": "UNARY* @primary @post* ( BIN UNARY* @primary @post* )*",
        "exprs": "@expr ( ', @expr )*",
        "simple": "( @exprs | @exprs ASSIGN @exprs | @exprs FIX | ( @exprs ASSIGN )? range @expr )",
        "spec": "NAME ( ', NAME )* ( @type? '= @exprs | @type )",
        "cspec": "NAME ( ', NAME )* ( @type? '= @exprs )?",
        "tspec": "NAME ( B:params )? ( '= )? @type",
        "decl": "( var ( @spec | P:specs ) | const ( @cspec | P:cspecs ) | type ( @tspec | P:tspecs ) )",
        "head": "( @simple? '; )? @simple?",
        "stmt": "( @simple | @decl | return @exprs? | break NAME? | continue NAME? | goto NAME | fallthrough | go @expr | defer @expr | C:block | if @head C:block ( else if @head C:block )* ( else C:block )? "
        "| for ( @head ( '; @simple? )? )? C:block | switch @head C:cases | select C:cases )",
        "stmts": "( ( NAME ': ( '; )? )* @stmt? '; )* ( NAME ': )* @stmt?",
        "import": "( NAME | '. )? STR",
    }
    param = "( NAME ( ', NAME )* )? ( '... )? @type"
    param = "NAME? ( '... )? @type"
    kinds = {
        "F:file": "( '; )* package NAME '; ( import ( @import | P:imports ) '; )* ( ( func ( P:params )? NAME ( B:params )? P:params @result? ( C:block )? | @decl )? '; )*",
        "P:imports": "( @import? '; )* @import?", "P:specs": "( @spec? '; )* @spec?", "P:cspecs": "( @cspec? '; )* @cspec?", "P:tspecs": "( @tspec? '; )* @tspec?",
        "C:block": "@stmts", "C:cases": "( ( case @simple ( ', @expr )* ': | default ': ) @stmts )*".replace("@stmts )*", "( '; )? @stmts )*"),
        "P:params": f"( {param} ( ', {param} )* ( ', )? )?", "B:params": "( NAME ( ', NAME )* ( @union )? ( ', NAME ( ', NAME )* ( @union )? )* ( ', )? )?",
        "P:args": "( @expr ( ', @expr )* ( '... )? ( ', )? )?", "P:exprs": "@exprs", "B:exprs": "@exprs ( ', )?", "B:empty": "", "B:dots": "'...", "B:slice": "@expr? ': @expr? ( ': @expr )?", "P:typeword": "type",
        "C:lit": "( ( @expr | C:lit ) ( ': ( @expr | C:lit ) )? ( ', ( @expr | C:lit ) ( ': ( @expr | C:lit ) )? )* ( ', )? )?",
        "C:struct": "( ( ( NAME ( ', NAME )* @type | ( '* )? NAME ( '. NAME )? ( B:exprs )? ) STR? )? '; )* ( ( NAME ( ', NAME )* @type | ( '* )? NAME ( '. NAME )? ( B:exprs )? ) STR? )?",
        "C:iface": "( ( NAME P:params @result? | @union )? '; )* ( NAME P:params @result? | @union )?",
    }
    r["union"] = "( '~ )? @type ( '| ( '~ )? @type )*"
    sets = {"UNARY": "UNOP * & - + ^ ! <-", "BIN": "BINOP * & - + ^ | <-", "ASSIGN": "= := ASSIGNOP", "FIX": "++ --"}
    return Grammar(_GO_WORDS, "{ } ( ) [ ] ; , . ... : = := * & - + ^ ! | ~ <- ++ --", "NAME NUM STR BINOP UNOP ASSIGNOP", sets, r, kinds)


# ---------------------------------------------------------------- java

_JAVA_WORDS = (
    "abstract assert break case catch class const continue default do else enum extends false final finally for goto if implements import instanceof interface native new null package "
    "private protected public return static strictfp super switch synchronized this throw throws transient true try void volatile while record sealed permits yield when var non"
)


@cache
def java() -> Grammar:
    r: dict[str, str] = {}
    ann = "'@ NAME ( '. NAME )* ( P:anns )?"
    r["targs"] = "'< ( @ann* ( WILD ( ( extends | super ) @type ( '& @type )* )? | @type ) ( ', )? )* '>"
    r["type"] = "@ann* NAME @targs? ( '. @ann* NAME @targs? )* ( @ann* B:empty )*"
    r["ann"] = ann
    r["mods"] = "( public | private | protected | static | final | abstract | default | native | synchronized | transient | volatile | strictfp | sealed | non '- sealed | @ann )*"
    r["tparams"] = "'< ( @ann* NAME ( extends @type ( '& @type )* )? ( ', )? )* '>"
    r["head"] = "( P:params '-> | NAME '-> | P:names '-> )"
    r["primary"] = "( NAME | NUM | STR | true | false | null | this | super | P:expr | @head C:block | new @ann* @type ( P:args ( C:class )? | ( B:expr )+ ( B:empty )* | C:init | B:empty ) | switch P:expr C:cases | void '. class )"
    r["post"] = "( '. ( NAME | this | super | class | new @type P:args ( C:class )? | @targs ( NAME | super | this ) ) | P:args | B:expr | ( B:empty )+ | FIX | ':: ( @targs )? ( NAME | new ) | @targs '. NAME | @targs ( B:empty )* '':: ( NAME | new ) | instanceof final? @type ( NAME | P:pats NAME? )? )".replace("'':: ", "':: ")
    operand = "( UNARY | P:type | @head )* @primary @post*"
    r["expr"] = f"{operand} ( ( BIN | '> '> ( '> )? | Q:expr ) {operand} )*"
    # Expressions that may stand as statements: assignment, increment, call, new.
    r["owner"] = "( NAME | STR | this | super | P:expr | new @ann* @type ( P:args ( C:class )? | ( B:expr )+ ( B:empty )* | C:init | B:empty ) | void '. class )"
    r["part"] = "( '. ( NAME | this | super | class | new @type P:args ( C:class )? | @targs ( NAME | super | this ) ) | P:args | B:expr | ( B:empty )+ )"
    r["place"] = "( NAME | P:expr | @owner @part* ( '. NAME | B:expr ) )"
    r["effect"] = "( @place ( '= | AUG ) @expr | @place FIX | FIX @place | @owner @part* P:args | @targs ( this | super ) P:args | new @ann* @type P:args ( C:class )? | @owner @part* '. new @type P:args ( C:class )? )"
    r["dims"] = "( B:empty )*"
    r["vars"] = "NAME @dims ( '= ( @expr | C:init ) )? ( ', NAME @dims ( '= ( @expr | C:init ) )? )*"
    r["typedecl"] = "@mods ( ( class | interface | record | '@ interface ) NAME @tparams? ( P:params )? ( extends @type ( ', @type )* )? ( implements @type ( ', @type )* )? ( permits @type ( ', @type )* )? C:class | enum NAME ( implements @type ( ', @type )* )? C:enum )"
    r["member"] = "( '; | @typedecl | @mods ( C:block | @tparams? ( ( @type | void ) NAME | NAME ) P:params @dims ( throws @type ( ', @type )* )? ( C:block | ( default ( @expr | C:init | @ann ) )? '; ) | @type @vars '; | NAME C:block ) )"
    r["pre"] = "( for P:for | while P:expr | do | NAME ': )"
    r["core"] = (
        "( C:block | '; | @typedecl | ( final | @ann )* @type @vars '; | @effect '; | return @expr? '; | throw @expr '; | break NAME? '; | continue NAME? '; | yield @expr '; | assert @expr ( ': @expr )? '; "
        "| try ( P:resources C:block ( catch P:catch C:block )* ( finally C:block )? | C:block ( ( catch P:catch C:block )+ ( finally C:block )? | finally C:block ) ) | switch P:expr C:steps | synchronized P:expr C:block )"
    )
    r["stmt"] = "( @pre* @core | ( @pre | if P:expr )* if P:expr @pre* @core ( else ( @pre | if P:expr )* @core )* )"
    param = "( final | @ann )* @type ( @ann* '... )? ( NAME | this | NAME '. this ) @dims"
    kinds = {
        "F:file": "( '; )* ( @ann* package NAME ( '. NAME )* '; )? ( import static? NAME ( '. NAME )* ( '. '* )? '; | '; )* ( @typedecl | '; )*",
        "C:class": "@member*", "C:enum": "( @ann* NAME ( P:args )? ( C:class )? ( ', @ann* NAME ( P:args )? ( C:class )? )* )? ( ', )? ( '; @member* )?", "C:block": "( @stmt )*",
        "C:cases": "( @choice ': @stmt* )* | ( @choice '-> ( @expr '; | C:block | throw @expr '; ) )*", "C:steps": "( @choice ': @stmt* )* | ( @choice '-> ( @effect '; | C:block | throw @expr '; ) )*", "P:expr": "@expr", "Q:expr": "@expr", "B:expr": "@expr", "B:empty": "", "P:type": "@type ( '& @type )*",
        "P:args": "( @expr ( ', @expr )* )?", "P:names": "( NAME ( ', NAME )* )?", "P:params": f"( {param} ( ', {param} )* )?", "P:pats": "( final? @type ( NAME | P:pats NAME? )? ( ', final? @type ( NAME | P:pats NAME? )? )* )?",
        "P:anns": "( ( NAME '= )? ( @expr | C:init | @ann ) ( ', NAME '= ( @expr | C:init | @ann ) )* )?", "C:init": "( ( @expr | C:init | @ann ) ( ', ( @expr | C:init | @ann ) )* )? ( ', )?",
        "P:for": "( ( final | @ann )* @type NAME ': @expr | ( ( final | @ann )* @type @vars | @effect ( ', @effect )* )? '; @expr? '; ( @effect ( ', @effect )* )? )",
        "P:catch": "( final | @ann )* @type ( '| @type )* NAME", "P:resources": "( ( final | @ann )* @type NAME '= @expr | @expr ) ( '; ( ( final | @ann )* @type NAME '= @expr | @expr ) )* ( '; )?",
    }
    r["choice"] = "( case @label ( ', @label )* ( when @expr )? | default )"
    r["label"] = "( @expr | default | @type ( NAME | P:pats NAME? ) )"
    soft = "record sealed permits yield when var non"
    sets = {"NAME": "WORD " + soft, "UNARY": "! ~ + - ++ --", "BIN": "BINOP AUG * & | + - < > =", "FIX": "++ --"}
    return Grammar(_JAVA_WORDS, "{ } ( ) [ ] ; , . ... ? : :: = -> * & | + - ! ~ < > @ ++ --", "WORD NUM STR BINOP AUG WILD", sets, r, kinds)


# ---------------------------------------------------------------- rust

_RUST_WORDS = (
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while "
    "union auto default macro_rules raw safe _"
)


@cache
def rust() -> Grammar:
    r: dict[str, str] = {}
    r["gargs"] = "'< ( ( LIFE | ID @gargs? '= @type | ID ': @type | @type | '- NUM | NUM | STR | true | false | C:block ) ( ', )? )* '>"
    r["seg"] = "( ID | self | Self | super | crate ) ( ( ':: )? @gargs | ( ':: )? P:types ( '-> @type )? )?"
    r["path"] = "( ':: | '< @type ( as @type )? '> ':: )? @seg ( ':: @seg )*"
    head = "( '& LIFE? mut? | '&& LIFE? mut? | '* ( const | mut ) | dyn | impl | '? | '~ const | for @life )"
    core = "( @path ( '! ( P:any | B:any | C:any ) )? | P:types | B:types,sized | '! | _ | LIFE | unsafe? ( extern STR? )? fn P:fnparams ( '-> @type )? )"
    r["type"] = f"{head}* {core} ( '+ ( {head}* {core} )? )*"
    r["life"] = "'< ( LIFE ( ', )? )* '>"
    r["gparams"] = "'< ( @attr* ( LIFE ( ': ( LIFE ( '+ )? )* )? | const ID ': @type ( '= ( @type | NUM | '- NUM | true | false | C:block ) )? | ID ( ': ( @type )? )? ( '= @type )? ) ( ', )? )* '>"
    r["attr"] = "'# ( '! )? B:any"
    r["vis"] = "pub ( P:any )? | crate"
    r["bounds"] = "( ': ( @type )? )?"
    r["where"] = "( where ( ( LIFE | @type ) ': ( @type )? ( ', )? )* )?"
    r["lit"] = "( '- )? ( NUM | STR | true | false )"
    r["patcore"] = "( ( '& | '&& | mut | ref | raw | const )* ( @lit | @path ( P:pats | C:patfields )? ( '! ( P:any | B:any | C:any ) )? | ID '@ | _ | P:pats | B:pats | C:block | '.. | '..= ) )"
    r["pat"] = "( '| )? @patcore+ ( '| @patcore+ )*"
    r["cparam"] = "@attr* @patcore+ ( ': @type )?"
    r["closure"] = "( for @life )? static? async? move? ( '|| | '| ( @cparam ( ', )? )* '| )"
    prefix = "( UNARY | '& ( raw ( const | mut ) | mut )? | '&& mut? | return | break LIFE? | continue LIFE? | @closure ( '-> @type )? | '.. | '..= | let @pat '= )*"
    r["exprpath"] = "( ':: | '< @type ( as @type )? '> ':: )? ( ID | self | Self | super | crate ) ( ':: ( ID | self | Self | super | '< ( ( LIFE | ID '= @type | @type | NUM | '- NUM | true | false | C:block ) ( ', )? )* '> ) )*"
    r["sprimary"] = "( NUM | STR | true | false | _ | @exprpath ( '! ( P:any | B:any | C:any ) )? | P:exprs | B:array | ( LIFE ': )? ( unsafe | async move? | const )? C:block | return | break LIFE? | continue LIFE? | '.. )"
    r["post"] = "( '. ( ID | NUM | await | self ) ( ':: '< ( ( LIFE | @type ) ( ', )? )* '> )? | P:exprs,args | B:exprs | '? | as @type | C:fields | '.. )"
    r["sexpr"] = f"{prefix} @sprimary @post* ( ( BIN | '> '> ( '= )? | '< '< ) {prefix} @sprimary @post* )*"
    r["ctl"] = "( LIFE ': )? ( if @sexpr C:block ( else if @sexpr C:block )* ( else C:block )? | match @sexpr C:arms | while @sexpr C:block | for @pat in @sexpr C:block | loop C:block )"
    r["expr"] = f"{prefix} @attr* ( @sprimary | @ctl ) @post* ( ( BIN | '> '> ( '= )? | '< '< ) {prefix} ( @sprimary | @ctl ) @post* )*"
    r["item"] = (
        "( ( const | async | unsafe | safe | default | extern STR? )* fn ID @gparams? P:params ( '-> @type )? @where ( C:block | '; ) "
        "| struct ID @gparams? ( @where C:sfields | P:tfields @where '; | @where '; ) | enum ID @gparams? @where C:variants | union ID @gparams? @where C:sfields "
        "| unsafe? auto? trait ID @gparams? @bounds @where ( C:items | '= @type '; ) | default? unsafe? impl @gparams? const? ( '! )? @type ( for @type )? @where C:items | unsafe? mod ID ( C:items | '; ) "
        "| use C:none '; | use ( ':: )? ( ( ID | self | super | crate ) ( ':: ( ID | self | super | crate ) )* ( ':: ( '* | C:uses ) )? ( as ( ID | _ ) )? | '* | C:uses ) '; "
        "| extern crate ( ID | self ) ( as ( ID | _ ) )? '; | unsafe? extern STR? C:items | ( default )? ( const | static ) mut? ( ID | _ ) ': @type ( '= @expr )? @where '; | const C:block | default? type ID @gparams? @bounds @where ( '= @type )? @where '; "
        "| macro_rules '! ID ( C:any | ( P:any | B:any ) '; ) | ( ( ID | self | super | crate ) ( ':: ID )* ) '! ID? ( C:any | ( P:any | B:any ) '; ) )"
    ).replace("| use C:none '; ", "")
    r["stmt"] = (
        "( '; | @attr* ( @vis )? @item | @attr* let @pat ( ': @type )? ( '= @expr ( else C:block )? )? '; | @attr* @expr '; | @attr* @ctl | @attr* ( LIFE ': )? ( unsafe | async move? | const )? C:block )"
    )
    kinds = {
        "F:file": "SHEBANG? ( '# '! B:any )* ( @attr* ( @vis )? @item )*", "C:items": "( @attr* ( @vis )? @item | '# '! B:any )*", "C:block": "( '# '! B:any )* @stmt* ( @attr* @expr )?",
        "P:types": "( @type ( ', @type )* ( ', )? )?", "B:types": "@type", "B:sized": "@type '; @expr", "P:fnparams": "( @attr* ( ( ID | _ ) ': )? ( @type | '... ) ( ', @attr* ( ( ID | _ ) ': )? ( @type | '... ) )* ( ', )? )?",
        "P:params": "( @attr* ( ( '& LIFE? )? mut? self ( ': @type )? | @pat ': ( @type | '... ) | @type | '... ) ( ', @attr* ( @pat ': ( @type | '... ) | @type | '... ) )* ( ', )? )?",
        "P:tfields": "( @attr* ( @vis )? @type ( ', @attr* ( @vis )? @type )* ( ', )? )?", "C:sfields": "( @attr* ( @vis )? ID ': @type ( ', @attr* ( @vis )? ID ': @type )* ( ', )? )?",
        "C:variants": "( @attr* ( @vis )? ID ( C:sfields | P:tfields )? ( '= @expr )? ( ', @attr* ( @vis )? ID ( C:sfields | P:tfields )? ( '= @expr )? )* ( ', )? )?",
        "C:uses": "( @usetree ( ', @usetree )* ( ', )? )?", "P:exprs": "( @attr* @expr ( ', @attr* @expr )* ( ', )? )?", "P:args": "( @expr ( ', @expr )* ( ', )? )?", "B:exprs": "@expr", "B:array": "( @attr* @expr ( '; @expr | ( ', @attr* @expr )* ( ', )? ) )?",
        "C:fields": "( @attr* ( ID | NUM ) ( ': @expr )? ( ', @attr* ( ID | NUM ) ( ': @expr )? )* ( ', )? ( '.. @expr? )? | '.. @expr )?", "C:arms": "( '# '! B:any )* ( @attr* @pat ( if @expr )? '=> ( @expr ', | ( @ctl | unsafe? C:block ) ( ', )? ) )* ( @attr* @pat ( if @expr )? '=> @expr )?",
        "P:pats": "( @attr* @pat ( ', @attr* @pat )* ( ', )? )?", "B:pats": "( @pat ( ', @pat )* ( ', )? )?", "C:patfields": "( @attr* ( ref? mut? ID | ( ID | NUM ) ': @pat | '.. ) ( ', @attr* ( ref? mut? ID | ( ID | NUM ) ': @pat | '.. ) )* ( ', )? )?",
    }
    r["usetree"] = "( ':: )? ( ( ID | self | super | crate ) ( ':: ( ID | self | super | crate ) )* ( ':: ( '* | C:uses ) )? ( as ( ID | _ ) )? | '* | C:uses )"
    sets = {"ID": "NAME union auto default macro_rules raw safe", "UNARY": "! - *", "BIN": "BINOP * - + & && | || = < > .. ..= in"}
    sets["BIN"] = "BINOP * - + & && | || = < > .. ..="
    return Grammar(_RUST_WORDS, "{ } ( ) [ ] ; , . .. ... ..= : :: = => -> # ! @ ? ~ * - + & && | || < >", "NAME NUM STR LIFE BINOP SHEBANG", sets, r, kinds)


# ---------------------------------------------------------------- python

_PY_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"


@cache
def python() -> Grammar:
    r = {
        "prefix": "( UNARY | not | await | lambdaX )".replace("lambdaX", "L:lambda"),
        "primary": "( NAME | NUM | ( STR | FSTR T:field* )+ | True | False | None | ELLIPSIS | P:tuple | B:list | C:set | yield from? | yield )",
        "post": "( '. NAME | P:args | B:index )",
        "operand": "@prefix* ( yield from? )? ( UNARY | not | await | L:lambda )* @primary @post*",
        "flat": "@operand ( ( BIN | is not? | not in | in | ':= ) @operand )*",
        "expr": "@flat ( if @flat else @expr )?",
        "star": "( '* )? @expr",
        "exprs": "@star ( ', @star )* ( ', )?",
        "comp": "( async? for @targets in @flat ( if @flat )* )+",
        "target": "( '* )? ( NAME | P:tuple | B:list | @primary @post* ( '. NAME | B:index ) )",
        "targets": "@target ( ', @target )* ( ', )?",
        "simple": "( ( @targets '= )* @exprs | @target AUG @exprs | @target ': @expr ( '= @exprs )? | del @exprs | pass | break | continue | return @exprs? | raise ( @expr ( from @expr )? )? | global NAME ( ', NAME )* | nonlocal NAME ( ', NAME )* | assert @expr ( ', @expr )? "
        "| import @dotted ( as NAME )? ( ', @dotted ( as NAME )? )* | from ( '. | ELLIPSIS )* @dotted? import ( '* | NAME ( as NAME )? ( ', NAME ( as NAME )? )* | P:names ) | type NAME ( B:params )? '= @exprs )",
        "dotted": "NAME ( '. NAME )*",
        "line": "@simple ( '; @simple )* ( '; )? NL",
        "suite": "': ( @line | NL INDENTED )".replace("INDENTED", "I:suite"),
        "stmt": "( @line | NL | ( '@ @expr NL )* ( async? def NAME ( B:params )? P:params ( '-> @expr )? @suite | class NAME ( B:params )? ( P:args )? @suite ) | if @expr @suite ( elif @expr @suite )* @else? | while @expr @suite @else? "
        "| async? for @targets in @exprs @suite @else? | try @suite ( ( except ( @expr ( as NAME )? )? @suite )+ @else? @finally? | ( except '* @expr ( as NAME )? @suite )+ @else? @finally? | @finally ) | async? with @items @suite | match @exprs ': NL I:cases )",
        "else": "else @suite",
        "finally": "finally @suite",
        "items": "( P:items | @expr ( as @expr )? ( ', @expr ( as @expr )? )* )",
    }
    # Positional arguments come before named ones, only ** and named ones after **; a generator stands alone.
    named, doubled = "( NAME '= @expr | '* @expr )", "( NAME '= @expr | '** @expr )"
    named = f"( {named} ( ', {named} )* ( ', {doubled} ( ', {doubled} )* )? | {doubled} ( ', {doubled} )* )"

    def params(one: str, rest: str) -> str:
        """Parameters in their order: without and with default, at most one /, then * or *rest, named ones, **."""
        default, key = f"{one} '= @expr", f"', {one} ( '= @expr )?"
        front = f"( {one} ( ', {one} )* ( ', '/ ( ', {one} )* )? ( ', {default} )* | ( {one} ', )* {default} ( ', {default} )* ( ', '/ ( ', {default} )* )? )"
        back = f"( ( '* {rest} ( {key} )* | '* ( {key} )+ ) ( ', '** {one} )? | '** {one} )"
        return f"( ( {front} ( ', {back} )? | {back} ) ( ', )? )?"

    type_par = "( NAME ( ': @expr )? ( '= @expr )? | '* NAME ( '= @star )? | '** NAME ( '= @expr )? )"
    kinds = {
        "F:file": "@stmt*", "I:suite": "@stmt+", "I:cases": "( case @exprs ( as NAME )? ( if @expr )? @suite )+", "T:field": "@exprs ( '= )? CONV? ( FSPEC T:field* )?", "P:tuple": f"( @exprs | @star @comp | yield from? @exprs? | NAME as NAME )? ( as NAME ( ', )? )?", "P:args": f"( ( ( '* )? @expr ( ', ( '* )? @expr )* ( ', {named} )? | {named} ) ( ', )? | @expr @comp )?", "P:names": "NAME ( as NAME )? ( ', NAME ( as NAME )? )* ( ', )?",
        "P:items": "@expr ( as @expr )? ( ', @expr ( as @expr )? )* ( ', )?", "B:list": "( @exprs | @star @comp )?", "B:index": "( @star? ( ': @expr? )* ( ', @star? ( ': @expr? )* )* )",
        "C:set": "( @exprs | @star @comp | ( @expr ': @expr | '** @expr ) ( ', ( @expr ': @expr | '** @expr ) )* ( ', )? | @expr ': @expr @comp )?", "P:params": params("NAME ( ': @expr )?", "NAME ( ': @star )?"), "L:lambda": params("NAME", "NAME"),
        "B:params": f"{type_par} ( ', {type_par} )* ( ', )?",
    }
    sets = {"NAME": "WORD match case type", "UNARY": "- + ~", "BIN": "BINOP * ** - + / and or"}
    return Grammar(_PY_WORDS + " match case type", "{ } ( ) [ ] ${ }$ INDENT DEDENT ; , . : = := -> @ * ** - + / ~", "WORD NUM STR FSTR FSPEC CONV ELLIPSIS BINOP AUG NL", sets, r, kinds)
