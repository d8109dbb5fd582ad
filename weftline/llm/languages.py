"""Grammars and lexers of the languages whose files are checked.

A language's dialects are alternatives of one grammar, tried together on the shared stack: scripts and modules,
sloppy and strict code (JavaScript, TypeScript), implementation and declaration files (TypeScript), classic and
compact compilation units and module declarations (Java), all minor versions of Python 3 up to 3.13. Words that are
reserved in some dialects only are keyword and name at once.
"""

from __future__ import annotations

import re

from weftline.llm.gll import NEW_LINE, Grammar, Recognizer, _any, derive


class Invalid(Exception):
    """The text is not valid in any dialect; the message tells why."""


# --- JSON ------------------------------------------------------------------

_JSON = r"""
value = STR | NUM | 'true' | 'false' | 'null' | B{members} | K{items}
members = ( STR ':' value ( ',' STR ':' value )* )?
items = ( value ( ',' value )* )?
"""

# --- JavaScript and TypeScript ---------------------------------------------

_ECMA = r"""
stmt = ';' | B{body} | & simple eos | decl | 'if' P{expr} stmt ( 'else' stmt )? | 'for' 'await'? P{forhead} stmt | 'while' P{expr} stmt | 'do' stmt 'while' P{expr} ';'?
  | 'try' B{body} ( 'catch' P{params}? B{body} ( 'finally' B{body} )? | 'finally' B{body} ) | 'switch' P{expr} B{cases} | 'with' P{expr} stmt | ID ':' stmt | 'import' importing eos | decorator* 'export' exporting | more_stmt
eos = ';' | ~ | $
simple = expr | vardecl | 'return' ( ^ expr )? | 'throw' ^ expr | ( 'break' | 'continue' ) ( ^ ID )? | 'debugger'
vardecl = ( 'var' | 'let' | 'await'? 'using' ) binding ( ',' binding )* | 'const' constant ( ',' constant )*
binding = target '!'? annotation? ( '=' assign )?
target = ID | B{object} | K{elements}
decl = 'async'? 'function' '*'? ID typeparams? P{params} annotation? ( B{body} | bodiless ) | decorator* classmark? 'class' ID typeparams? heritage B{classbody}
heritage = ( 'extends' postfix typeargs? )? implementing
decorator = '@' postfix
importing = STR withclause? | importclause 'from' STR withclause?
importmeta = '.' NAME | P{args}
importclause = ID ( ',' ( B{names} | '*' 'as' ID ) )? | B{names} | '*' 'as' ID
withclause = ( 'with' | 'assert' ) B{object}
names = ( name ( ',' name )* ','? )?
name = NAME ( 'as' ( NAME | STR ) )? | STR ( 'as' ( NAME | STR ) )? | more_name
exporting = 'default' ( anonymous | assign eos ) | decl | vardecl eos | B{names} ( 'from' STR withclause? )? eos | '*' ( 'as' ( NAME | STR ) )? 'from' STR withclause? eos
anonymous = 'async'? 'function' '*'? ID? typeparams? P{params} annotation? ( B{body} | bodiless ) | decorator* classmark? 'class' ID? typeparams? heritage B{classbody}
caseitem = 'case' expr ':' | 'default' ':' | stmt
expr = assign ( ',' assign )*
assign = binary ( '?' assign ':' assign )? | postfix cast* asg assign | arrow | 'yield' ( ^ '*'? assign )?
asg = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | '>' '>=' | '>' '>' '>='
binary = unary cast* ( operator unary cast* )*
operator = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '<=' | '>' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof'
unary = ( '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | more_prefix )* postfix ( ^ ( '++' | '--' ) )?
postfix = primary suffix*
suffix = '.' ( NAME | PRIVATE ) | '?.' ( NAME | PRIVATE | P{args} | K{expr} ) | P{args} | K{expr} | template | more_suffix
template = TPL T{expr}*
primary = ID | NUM | STR | REGEX | PRIVATE | template | P{expr} | K{elements} | B{object} | 'this' | 'super' | 'null' | 'true' | 'false' | 'new' ( newtarget | '.' NAME ) | 'import' importmeta
  | 'async'? 'function' '*'? ID? typeparams? P{params} annotation? B{body} | decorator* 'class' ID? typeparams? heritage B{classbody}
newtarget = primary ( '.' ( NAME | PRIVATE ) | K{expr} | template | more_callee )* typeargs? P{args}?
arrow = 'async'? ( ID | typeparams? P{params} annotation? ) ^ '=>' ( B{body} | % assign )
args = ( arg ( ',' arg )* ','? )?
arg = '...'? assign
elements = ( ','* arg ( ','+ arg )* )? ','*
object = ( prop ( ',' prop )* ','? )?
prop = key ':' assign | ID ( '=' assign )? | '...' assign | ( 'async' | 'get' | 'set' )? '*'? key optional? typeparams? P{params} annotation? B{body}
key = NAME | STR | NUM | K{expr}
params = ( param ( ',' param )* ','? )?
param = decorator* modifier* ( '...'? target | 'this' ) optional? annotation? ( '=' assign )?
forhead = ( vardecl | expr )? ';' expr? ';' expr? | ( ( 'var' | 'let' | 'const' | 'await'? 'using' ) target annotation? | expr ) ( 'of' assign | 'in' expr )
member = ';' | decorator* modifier* ( 'async' | 'get' | 'set' )? '*'? mkey optional? typeparams? P{params} annotation? ( B{body} | bodiless ) | decorator* modifier* mkey ( optional | '!' )? annotation? ( '=' assign )? eos | 'static' B{body} | more_member
mkey = key | PRIVATE
"""
_JS_ONLY = r"""
annotation = NEVER
typeparams = NEVER
typeargs = NEVER
implementing = ( NEVER )?
modifier = 'static' | 'accessor'
constant = target '=' assign
classmark = NEVER
optional = NEVER
cast = NEVER
bodiless = NEVER
more_stmt = NEVER
more_name = NEVER
more_prefix = NEVER
more_suffix = NEVER
more_callee = NEVER
more_member = NEVER
"""
_TS_ONLY = r"""
annotation = ':' returned
returned = 'asserts' ( ID | 'this' ) ( 'is' type )? | ( ID | 'this' ) 'is' type | type
typeparams = '<' typeparam ( ',' typeparam )* ','? '>'
typeparam = ( 'const' | 'in' | 'out' )* ID ( 'extends' type )? ( '=' type )?
typeargs = '<' type ( ',' type )* ','? '>'
implementing = ( 'implements' typename ( ',' typename )* )?
constant = binding
modifier = 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override' | 'accessor'
classmark = 'abstract'
optional = '?'
cast = ( 'as' | 'satisfies' ) ( type | 'const' )
bodiless = eos
more_name = 'type' NAME ( 'as' ( NAME | STR ) )? | 'type' STR 'as' NAME
more_prefix = '<' ( type | 'const' ) '>'
more_suffix = ^ '!' | typeargs ( P{args} | template )? | '?.' typeargs P{args}
more_callee = ^ '!'
more_member = modifier* K{indexer} annotation? eos
indexer = ID ':' type | ID 'in' type ( 'as' type )?
more_stmt = 'global' B{body} | 'type' ID typeparams? '=' type eos | interface | 'const'? 'enum' ID B{enumbody} | 'declare' ( more_stmt | decl | vardecl eos )
  | ( 'namespace' | 'module' ) ( ID ( '.' ID )* | STR ) ( B{body} | eos ) | 'import' 'type' importclause 'from' STR withclause? eos | 'import' 'type'? ID '=' expr eos
  | 'export' ( more_stmt | 'type' ( B{names} ( 'from' STR withclause? )? | '*' ( 'as' NAME )? 'from' STR withclause? ) eos | '=' expr eos | 'as' 'namespace' ID eos | 'default' interface )
interface = 'interface' ID typeparams? ( 'extends' typename ( ',' typename )* )? B{typebody}
type = union ( ^ 'extends' union '?' type ':' type )?
union = ( '|' | '&' )? tone ( ( '|' | '&' ) tone )*
tone = ( 'keyof' | 'readonly' | 'unique' )* tprimary ( ^ K{tindex} )* | 'infer' ID ( 'extends' union )? | typeparams? P{params} '=>' returned | 'abstract'? 'new' typeparams? P{params} '=>' type
tprimary = typename | P{type} | B{typebody} | K{tuple} | STR | '-'? NUM | TPL T{type}* | 'typeof' ( typename | 'this' ( '.' NAME )* | typeimport ) | 'this' | 'null' | 'true' | 'false' | 'void' | typeimport
typeimport = 'import' P{args} ( '.' NAME )* typeargs?
typename = ID ( '.' NAME )* ( ^ typeargs )?
tindex = type?
tuple = ( titem ( ',' titem )* ','? )?
titem = '...'? ( NAME '?'? ':' )? '...'? type '?'?
typemember = ';' | ',' | ( 'readonly' | '+' | '-' )* ( 'get' | 'set' )? key '?'? ( typeparams? P{params} )? annotation? tend | 'new'? typeparams? P{params} annotation? tend | ( 'readonly' | '+' | '-' )* K{indexer} ( '+' | '-' )? '?'? annotation? tend
tend = ';' | ',' | ~ | $
enumbody = ( enumitem ( ',' enumitem )* ','? )?
enumitem = ( NAME | STR | K{expr} ) ( '=' assign )?
"""

# --- Go ---------------------------------------------------------------------

_GO = r"""
item = ';' | 'package' ID end | 'import' ( importspec | P{imports} ) end | top end
end = ';' | $
importspec = ( ID | '.' )? STR
imports = ( importspec ( ';' importspec )* ';'? )?
top = 'func' P{params}? ID tparams? P{params} result? B{body}? | declaration
declaration = 'var' ( varspec | P{vars} ) | 'const' ( varspec | P{vars} ) | 'type' ( typespec | P{types} )
vars = ( varspec ( ';' varspec )* ';'? )?
varspec = idlist type? ( '=' exprs )?
idlist = ID ( ',' ID )*
types = ( typespec ( ';' typespec )* ';'? )?
typespec = ID tparams? '='? type
tparams = K{tparamlist}
tparamlist = idlist constraint ( ',' idlist constraint )* ','?
constraint = '~'? type ( '|' '~'? type )*
type = ID ( '.' ID )? K{typeargs}? | '*' type | K{length} type | 'map' K{type} type | 'chan' '<-'? type | '<-' 'chan' type | 'func' P{params} result? | 'struct' B{fields} | 'interface' B{methods} | P{type}
typeargs = type ( ',' type )* ','?
length = ( expr | '...' )?
result = P{params} | type
params = ( param ( ',' param )* ','? )?
param = ID? '...'? type
fields = ( field ( ';' field )* ';'? )?
field = idlist type STR? | '*'? ID ( '.' ID )? K{typeargs}? STR?
methods = ( method ( ';' method )* ';'? )?
method = ID P{params} result? | constraint
bodyitem = ';' | label end | stmt end
label = ID ':'
stmt = label stmt | declaration | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'go' expr | 'defer' expr | B{body} | ifstmt | 'for' forhead B{body} | 'switch' ( simple? ';' )? ( simple )? B{cases} | 'select' B{cases}
ifstmt = 'if' ( simple? ';' )? hexpr B{body} ( 'else' ( ifstmt | B{body} ) )?
forhead = ( hexpr | simple? ';' hexpr? ';' simple? | ( exprs ( ':=' | '=' ) )? 'range' hexpr )?
caseitem = ';' | 'case' caseof ':' | 'default' ':' | label end | stmt end
caseof = typeorexpr ( ',' typeorexpr )* | simple
typeorexpr = expr | type
simple = exprs | exprs ( '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ) exprs | expr ( '++' | '--' ) | expr '<-' expr
exprs = expr ( ',' expr )*
hexpr = expr
expr = unary ( binop unary )*
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' | '&^'
unary = ( '+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~' )* primary suffix*
suffix = '.' ( ID | P{assertion} ) | P{args} | K{index} | B{literal}
assertion = type | 'type'
index = expr? ':' expr? ( ':' expr )? | typeorexpr ( ',' typeorexpr )* ','?
args = ( arg ( ',' arg )* '...'? ','? )?
arg = expr | type
primary = ID | NUM | STR | CHR | P{expr} | P{type} | 'func' P{params} result? B{body}? | K{length} type | 'map' K{type} type | 'struct' B{fields} | 'chan' type | 'interface' B{methods}
literal = ( element ( ',' element )* ','? )?
element = ( value ':' )? value
value = expr | B{literal}
"""

# --- Java -------------------------------------------------------------------

_JAVA = r"""
item = member | ';' | 'package' name ';' | annotations 'package' name ';' | 'import' 'static'? name ( '.' '*' )? ';' | typedecl | 'open'? 'module' name B{directives}
name = ID ( '.' ID )*
directive = ( 'requires' | 'exports' | 'opens' | 'uses' | 'provides' ) ( 'static' | 'transitive' )* name ( ( 'to' | 'with' ) name ( ',' name )* )? ';'
annotations = annotation+
annotation = '@' name P{annargs}?
annargs = ( annarg ( ',' annarg )* )?
annarg = ( ID '=' )? elementvalue
elementvalue = expr | annotation | B{annvalues}
annvalues = ( elementvalue ( ',' elementvalue )* )? ','?
modifier = annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
typedecl = modifier* ( 'class' ID tparams? ( 'extends' type )? implementing? permits? B{classbody} | 'interface' ID tparams? ( 'extends' typelist )? permits? B{classbody} | 'enum' ID implementing? B{enumbody} | 'record' ID tparams? P{params} implementing? B{classbody} | '@' 'interface' ID B{classbody} )
implementing = 'implements' typelist
permits = 'permits' typelist
typelist = type ( ',' type )*
tparams = '<' tparam ( ',' tparam )* '>'
tparam = annotation* ID ( 'extends' type ( '&' type )* )?
type = annotation* ( ID targs? ( '.' annotation* ID targs? )* | PRIM ) ( annotation* K{nothing} )*
targs = '<' ( targ ( ',' targ )* )? '>'
targ = type | annotation* '?' ( ( 'extends' | 'super' ) type )?
nothing = NEVER?
enumbody = ( enumconst ( ',' enumconst )* )? ','? ( ';' member* )?
enumconst = annotation* ID P{args}? B{classbody}?
member = ';' | 'static'? B{block} | typedecl | modifier* tparams? ( type | 'void' ) ID P{params} ( K{nothing} )* ( 'throws' typelist )? ( B{block} | ( 'default' elementvalue )? ';' ) | modifier* tparams? ID P{params} ( 'throws' typelist )? B{block} | modifier* ID B{block} | modifier* type vars ';'
vars = var ( ',' var )*
var = ID ( K{nothing} )* ( '=' ( expr | B{arrayinit} ) )?
arrayinit = ( init ( ',' init )* )? ','?
init = expr | B{arrayinit}
params = ( param ( ',' param )* )?
param = modifier* type ( annotation* '...' )? ( ID '.' )? ( ID | 'this' ) ( K{nothing} )*
stmt = ';' | B{block} | localvar ';' | typedecl | 'if' P{expr} stmt ( 'else' stmt )? | 'for' P{forhead} stmt | 'while' P{expr} stmt | 'do' stmt 'while' P{expr} ';' | 'try' P{resources}? B{block} ( 'catch' P{catchparam} B{block} )* ( 'finally' B{block} )? | 'switch' P{expr} B{cases}
  | 'synchronized' P{expr} B{block} | 'return' expr? ';' | 'throw' expr ';' | 'break' ID? ';' | 'continue' ID? ';' | 'yield' expr ';' | 'assert' expr ( ':' expr )? ';' | ID ':' stmt | expr ';'
localvar = modifier* type vars
resources = resource ( ';' resource )* ';'?
resource = modifier* type ID '=' expr | expr
catchparam = modifier* type ( '|' type )* ID
forhead = ( localvar | expr ( ',' expr )* )? ';' expr? ';' ( expr ( ',' expr )* )? | modifier* type ID ':' expr
caseitem = ( 'case' pattern ( ',' pattern )* ( 'when' expr )? | 'default' ) ( ':' | '->' ( B{block} | 'throw' expr ';' | expr ';' ) ) | stmt
pattern = expr | modifier* type ID | 'default' | type P{patterns} ID?
patterns = ( subpattern ( ',' subpattern )* )?
subpattern = modifier* type ID | type P{patterns} ID?
expr = operand ( binop operand | 'instanceof' ( 'final'? type ID? | type P{patterns} ) )* ( '?' expr ':' expr )? ( asg expr )? | lambda
asg = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
binop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||'
operand = ( '+' | '-' | '!' | '~' | '++' | '--' | P{casttype} )* ( primary suffix* ( '++' | '--' )? | lambda )
casttype = type ( '&' type )*
suffix = '.' ( annotation* targs? ( ID | 'this' | 'new' | 'class' | 'super' ) ) | P{args} | K{expr} | '::' targs? ( ID | 'new' )
primary = ID | NUM | STR | CHR | 'this' | 'super' | 'true' | 'false' | 'null' | P{expr} | PRIM ( K{nothing} )* ( '.' 'class' | '::' 'new' ) | 'void' '.' 'class' | ID targs ( K{nothing} )* '::' ( ID | 'new' ) | ID ( '.' ID )* ( K{nothing} )+ ( '.' 'class' | '::' 'new' ) | 'new' creator | 'switch' P{expr} B{cases}
creator = annotation* targs? ( ID targs? ( '.' ID targs? )* | PRIM ) ( P{args} B{classbody}? | ( K{nothing} )+ B{arrayinit} | ( K{expr} )+ ( K{nothing} )* )
lambda = ( ID | P{lparams} ) '->' ( B{block} | expr )
lparams = ( ID ( ',' ID )* )? | params
args = ( expr ( ',' expr )* )?
"""

# --- Python ------------------------------------------------------------------

_PY_LINE = r"""
simple = small ( ';' small )* ';'?
small = exprs | assignment | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' ( test ( 'from' test )? )? | 'global' names | 'nonlocal' names | 'del' targets | 'assert' test ( ',' test )? | 'import' dotted ( ',' dotted )* | 'from' ( '.' | '...' )* dottedname? 'import' imported
  | 'yield' yielded? | 'type' ID tparams? '=' test
names = ID ( ',' ID )*
dottedname = ID ( '.' ID )*
dotted = dottedname ( 'as' ID )?
imported = '*' | importnames | P{importparen}
importnames = ID ( 'as' ID )? ( ',' ID ( 'as' ID )? )*
importparen = importnames ','?
assignment = ( targets '=' )+ value | onetarget ':' test ( '=' value )? | onetarget aug value
aug = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
value = exprs | 'yield' yielded?
yielded = exprs | 'from' test
targets = target ( ',' target )* ','?
target = '*'? onetarget
onetarget = ID | atom trailer* ( '.' ID | K{subscript} ) | P{targetlist} | K{targetlist}
targetlist = targets?
exprs = starexpr ( ',' starexpr )* ','?
starexpr = '*' orexpr | test
test = logic ( 'if' logic 'else' test )? | 'lambda' lparams? ':' test
namedtest = ID ':=' test | test
logic = 'not'* comparison ( ( 'and' | 'or' ) 'not'* comparison )*
comparison = orexpr ( ( '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ) orexpr )*
orexpr = factor ( ( '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ) factor )*
factor = ( '+' | '-' | '~' )* 'await'? atom trailer*
trailer = P{args} | K{subscript} | '.' ID
atom = ID | NUM | STR+ | '...' | 'None' | 'True' | 'False' | P{paren} | K{list} | B{braces}
paren = ( 'yield' yielded? | items | starred comprehension )?
items = item ( ',' item )* ','?
item = '*' orexpr | namedtest
starred = item
list = ( items | item comprehension )?
comprehension = ( 'async'? 'for' targets 'in' logic ( 'if' logic | 'if' ID ':=' test )* )+
braces = ( pair ( ',' pair )* ','? | test ':' test comprehension | items | item comprehension )?
pair = test ':' test | '**' orexpr
subscript = slice ( ',' slice )* ','?
slice = test? ':' test? ( ':' test? )? | '*' orexpr | namedtest
args = ( positional ( ',' named )? ','? | named ','? | namedtest comprehension )?
positional = posarg ( ',' posarg )*
posarg = namedtest | '*' test
named = keyarg ( ',' keyarg )* ( ',' lastarg )* | '**' test ( ',' lastarg )*
keyarg = ID '=' test | '*' test
lastarg = ID '=' test | '**' test
params = ( plain ( ',' defaults )? ( ',' starred_params )? ','? | defaults ( ',' starred_params )? ','? | starred_params ','? )?
plain = ( bare | '/' ) ( ',' ( bare | '/' ) )*
defaults = bare '=' test ( ',' ( bare '=' test | '/' ) )*
bare = ID ( ':' test )?
starred_params = '*' ( ID ( ':' ( test | '*' orexpr ) )? )? ( ',' bare ( '=' test )? )* ( ',' '**' bare )? | '**' bare
lparams = lplain ( ',' ldefaults )? ( ',' lstarred )? ','? | ldefaults ( ',' lstarred )? ','? | lstarred ','?
lplain = ( ID | '/' ) ( ',' ( ID | '/' ) )*
ldefaults = ID '=' test ( ',' ( ID '=' test | '/' ) )*
lstarred = '*' ID? ( ',' ID ( '=' test )? )* ( ',' '**' ID )? | '**' ID
tparams = K{tparamlist}
tparamlist = tparam ( ',' tparam )* ','?
tparam = ( '*' | '**' )? ID ( ':' test )? ( '=' test )?
withitems = withitem ( ',' withitem )*
withitem = test ( 'as' target )?
withparen = withitem ( ',' withitem )* ','?
if_h = 'if' namedtest ':'
elif_h = 'elif' namedtest ':'
else_h = 'else' ':'
while_h = 'while' namedtest ':'
for_h = 'async'? 'for' targets 'in' exprs ':'
try_h = 'try' ':'
except_h = 'except' '*'? ( test ( ',' test )* ( 'as' ID )? )? ':'
finally_h = 'finally' ':'
with_h = 'async'? 'with' ( withitems | P{withparen} ) ':'
def_h = 'async'? 'def' ID tparams? P{params} ( '->' test )? ':'
class_h = 'class' ID tparams? P{args}? ':'
match_h = 'match' exprs ':'
case_h = 'case' patterns ( 'if' namedtest )? ':'
patterns = pattern ( ',' pattern )* ','?
pattern = '*' ID | orpattern ( 'as' ID )?
orpattern = closed ( '|' closed )*
closed = ( '-' )? NUM ( ( '+' | '-' ) NUM )? | STR+ | 'None' | 'True' | 'False' | ID ( '.' ID )* P{patargs}? | P{patparen} | K{patparen} | B{patmap}
patparen = patterns?
patargs = ( patarg ( ',' patarg )* ','? )?
patarg = ( ID '=' )? pattern
patmap = ( patpair ( ',' patpair )* ','? )?
patpair = closed ':' pattern | '**' ID
decorator = '@' namedtest
inline = simple
"""
_PY_HEADS = ("if_h", "elif_h", "else_h", "while_h", "for_h", "try_h", "except_h", "finally_h", "with_h", "def_h", "class_h", "match_h", "case_h")
_PY_BLOCK = r"""
stmt = S | IF ( ELIF )* ELSE? | WHILE ELSE? | FOR ELSE? | TRY ( EXCEPT+ ELSE? FINALLY? | FINALLY ) | WITH | DEC* ( DEF | CLASS ) | MATCH
casestmt = CASE
"""


def _ecma(extra: str) -> Grammar:
    # contents that are lists of statements or members
    return Grammar(_ECMA.strip() + "\n" + extra.strip() + "\nbody = NEVER\ncases = NEVER\nclassbody = NEVER\ntypebody = NEVER\n")


_WORDS_JS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_WORDS_GO = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_WORDS_JAVA = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
_WORDS_PY = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PRIM = frozenset("boolean byte char double float int long short".split())

_OPENERS = {"(": -1, "[": -2, "{": -3, "${": -4}
_CLOSERS = {")": -5, "]": -6, "}": -7, "}$": -8}
_BRACKET = {-1: "P", -2: "K", -3: "B", -4: "T", -5: "P", -6: "K", -7: "B", -8: "T"}
BAD = 0


class Language:
    """A grammar with its lexer. ``tokens`` maps a token's text to its mask (negative: a bracket, 0: not a token)."""

    def __init__(self, grammar: Grammar, lists: dict[str, str], words: frozenset, kinds: dict[str, str], letters: str = "_$"):
        self.g, self.rec, self.words, self.kinds, self.letters = grammar, Recognizer(grammar, lists), words, kinds, letters
        self.masks: dict[str, int] = {}

    def mask(self, token: str) -> int:
        got = self.masks.get(token)
        if got is None:
            if len(self.masks) > 200_000:
                self.masks.clear()
            got = self.masks[token] = self._mask(token)
        return got

    def _mask(self, token: str) -> int:
        if token in _OPENERS:
            return _OPENERS[token]
        if token in _CLOSERS:
            return _CLOSERS[token]
        bits = self.g.bits
        got = bits.get("'" + token, 0)
        c = token[0]
        if c == "\n":
            return bits.get("NL", 0)
        if token[-1] in _QUOTES:  # a literal; a lone quote is none
            kind = next((k for first, k in self.kinds.items() if token[-1] in first), None)
            return bits.get(kind, 0) if len(token) > 1 and kind else BAD
        if c.isalpha() or c in "_$" or ord(c) > 127:
            if "$" in token and "$" not in self.letters or not re.fullmatch(r"[^\W\d]\w*|[\w$]+", token):
                return BAD
            got |= bits.get("NAME", 0)
            if token in self.words:
                got |= bits.get("PRIM", 0) if token in _PRIM else 0
            else:
                got |= bits.get("ID", 0)
            return got
        for first, kind in self.kinds.items():
            if c in first:
                return got or bits.get(kind, 0)
        return got

    def fold(self, masks: list[int], can_end: int = 0, goes_on: int = 0, newline: int = 0) -> list[int]:
        """Replace each bracket with its mask. A token that begins a line is marked with ``NEW_LINE`` where statements
        stand, if the token before may end one (``can_end``) and it does not itself only go on with one (``goes_on``)."""
        rec, stack, cur, bracket, prev, nl = self.rec, [], [], "", 0, False
        for m in masks:
            if m > 0:
                if m == newline:
                    nl = True
                    continue
                if nl:
                    nl = False
                    if prev & can_end and not m & goes_on and (bracket == "B" or not bracket):
                        cur.append(m | NEW_LINE)
                        prev = m
                        continue
                cur.append(m)
                prev = m
            elif m == BAD:
                raise Invalid("a character that starts no token")
            elif m > -5:
                mark = NEW_LINE if nl and prev & can_end and (bracket == "B" or not bracket) else 0
                nl = False
                stack.append((cur, bracket, mark))
                cur, bracket, prev = [], _BRACKET[m], 0
            else:
                nl = False
                if bracket != _BRACKET[m] or not stack:
                    raise Invalid("a bracket that closes nothing")
                got = rec.content(bracket, cur)
                if not got:
                    raise Invalid("the content of a bracket")
                cur, bracket, mark = stack.pop()
                cur.append(got | mark)
                prev = -1 if can_end else 0  # every bracket may end a statement
        if stack:
            raise Invalid("a bracket that is not closed")
        return cur

    def check(self, name: str, toks: list[int]) -> bool:
        return self.rec.accepts(name, (*toks, 1))


# --- lexers --------------------------------------------------------------------

_ID = r"(?:[^\W\d]|\$)[\w$]*"
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_BLOCK = r"/\*[\s\S]*?\*/"
_OPS = sorted(
    "=== !== ** **= => ... ?. ?? ??= && &&= || ||= == != <= >= << <<= ++ -- += -= *= /= %= &= |= ^= := <- &^ &^= :: -> + - * / % = < > ! ~ & | ^ ? : ; , . @ # ( ) [ ] { }".split(), key=len, reverse=True
)
_OPS_RE = "|".join(re.escape(o) for o in _OPS)
_JS_TOKEN = re.compile(rf"(?:[ \t\r\f\v﻿\xa0]+|//[^\n]*|{_BLOCK})*(\n|#?{_ID}|{_NUMBER}n?(?![\w$])|{_DQ}|{_SQ}|`(?:[^`\\$]|\\[\s\S]|\$(?!\{{))*`|\?\.(?!\d)|{_OPS_RE}|[\s\S]|\Z)")
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_GO_TOKEN = re.compile(rf"(?:[ \t\r]+|//[^\n]*|/\*[^\n]*?\*/)*(\n|{_BLOCK}|{_ID}|{_NUMBER}i?(?!\w)|{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)'|>>=|>>|{_OPS_RE}|[\s\S]|\Z)")
_JAVA_TOKEN = re.compile(rf'(?:\s+|//[^\n]*|{_BLOCK})*({_ID}|(?:{_NUMBER}|0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d+)[lLfFdD]?(?!\w)|"""[ \t\f\r]*\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|{_DQ}|' + r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'" + rf"|{_OPS_RE}|[\s\S]|\Z)")
_JSON_TOKEN = re.compile(r'[ \t\r\n]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[{}\[\]:,]|true\b|false\b|null\b|NaN\b|-?Infinity\b|[\s\S]|\Z)')
_PY_INNER = r"\{[^{}\"'\n]*\}"
_PY_FIELD = rf"\{{(?:[^{{}}\"']|\"(?:[^\"\n{{}}]|{_PY_INNER})*\"|'(?:[^'\n{{}}]|{_PY_INNER})*'|{_PY_INNER})*\}}"  # may hold line ends and any quotes
_PY_STRING = (
    r"(?:(?:[fF]|[rR][fF]|[fF][rR])(?:(?!\"\"\")\"(?:[^\"\\\n{]|\\[\s\S]|" + _PY_FIELD + r"|\{)*\"|(?!''')'(?:[^'\\\n{]|\\[\s\S]|" + _PY_FIELD + r"|\{)*')"
    r"|(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'(?:[^'\\\n]|\\[\s\S])+'|''(?!')|\"(?:[^\"\\\n]|\\[\s\S])+\"|\"\"(?!\")))"
)
_PY_DIGITS = r"\d(?:_?\d)*"
_PY_EXPONENT = rf"[eE][+-]?{_PY_DIGITS}"
_PY_NUMBER = (
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    rf"|(?:(?:{_PY_DIGITS})?\.{_PY_DIGITS}|{_PY_DIGITS}\.)(?:{_PY_EXPONENT})?[jJ]?|{_PY_DIGITS}(?:{_PY_EXPONENT}[jJ]?|[jJ])|0(?:_?0)*|[1-9](?:_?\d)*)(?!\w)"
)
_PY_OPS = "|".join(re.escape(o) for o in sorted("**= //= >>= <<= ... := -> ** // >> << <= >= == != += -= *= /= %= &= |= ^= @= + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =".split(), key=len, reverse=True))
_PY_TOKEN = re.compile(rf"(?:[ \t\f]+|\\\r?\n|#[^\n]*|\r(?=\n))*(\n[ \t\f]*|{_PY_STRING}|[^\W\d]\w*|{_PY_NUMBER}|{_PY_OPS}|[\s\S]|\Z)")

_QUOTES = "\"'`"


def _tokens(pattern: re.Pattern, text: str) -> list[str]:
    out = pattern.findall(text)
    while out and not out[-1]:
        out.pop()
    return out


def _js_slow(lang: Language, text: str) -> list[str]:
    """Tokens of a text with regex literals or template holes."""
    out: list[str] = []
    at, n = 0, len(text)
    holes: list[int] = []  # open curly brackets at each template hole
    opened: list[bool] = []  # for each open bracket: whether a slash after its end divides
    prev, divides = "", False
    while at < n:
        m = _JS_TOKEN.match(text, at)
        tok = m.group(1)
        start = m.start(1)
        if not tok:
            break
        if tok in ("/", "/=") and not divides:
            r = _JS_REGEX.match(text, start)
            if r:
                out.append("/re/")
                at, prev, divides = r.end(), "/re/", True
                continue
        if tok == "`" or tok == "}" and holes and holes[-1] == 0:
            if tok == "}":
                holes.pop()
            out.append("``" if tok == "`" else "}$")
            at, hole = _template(text, start + 1)
            prev, divides = "`", not hole
            if hole:
                out.append("${")
                holes.append(0)
            continue
        at = m.end()
        out.append(tok)
        if tok == "\n":
            continue
        if tok in ("(", "[", "{"):
            if holes and tok == "{":
                holes[-1] += 1
            # a condition's bracket is followed by a statement, and so is a block
            opened.append(prev not in _JS_HEADS if tok == "(" else tok == "[" or prev in _JS_BEFORE_OBJECT)
            divides = False
        elif tok in (")", "]", "}"):
            if holes and tok == "}":
                holes[-1] -= 1
            divides = opened.pop() if opened else True
        elif tok in ("++", "--"):
            pass  # as before it: a sign after an operand divides
        else:
            divides = (tok[0].isalnum() or tok[0] in "_$\"'`#." or ord(tok[0]) > 127) and tok not in _JS_BEFORE_REGEX and tok not in (".", "...") or prev == "." and tok[0].isalpha()
        prev = tok
    if holes:
        raise Invalid("a template that is not closed")
    return out


_JS_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())
_JS_HEADS = frozenset("if while for with".split())
_JS_BEFORE_OBJECT = frozenset("= ( [ , ? : return typeof in of && || ?? + - ! += == === != !== ... case throw".split())
_TEMPLATE_PART = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")


def _template(text: str, at: int) -> tuple[int, bool]:
    """Where the next hole of a template or the template ends, and whether it is a hole."""
    m = _TEMPLATE_PART.match(text, at)
    if not m:
        raise Invalid("a template that is not closed")
    return m.end(), m.group(1) == "${"


def _ecma_masks(lang: Language, text: str) -> list[int]:
    text = text.lstrip("\ufeff")
    if text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    toks = _tokens(_JS_TOKEN, text)
    if "`" in toks or "/" in toks or "/=" in toks:
        toks = _js_slow(lang, text)
    return [lang.mask(t) for t in toks]


def _check_ecma(lang: Language, text: str) -> bool:
    b = lang.g.bits
    folded = lang.fold(_ecma_masks(lang, text), lang.can_end, lang.goes_on, b["NL"])
    return lang.check("program", folded)


def _go_masks(lang: Language, text: str) -> list[int]:
    semi, ends, out, last = lang.mask(";"), lang.can_end, [], 0
    toks = _tokens(_GO_TOKEN, text)
    toks.append("\n")
    for t in toks:
        if t == "\n" or t.startswith("/*"):
            if "\n" in t and (last & ends if last > 0 else last in (-5, -6, -7)):
                out.append(semi)
                last = semi
            continue
        last = lang.mask(t)
        out.append(last)
    return out


def _check_go(lang: Language, text: str) -> bool:
    folded = lang.fold(_go_masks(lang, text.lstrip("﻿")))
    return bool(folded) and bool(folded[0] & lang.g.bits["'package"]) and lang.check("program", folded)


def _check_java(lang: Language, text: str) -> bool:
    toks = _tokens(_JAVA_TOKEN, text.lstrip("﻿"))
    folded = lang.fold([lang.mask(t) for t in toks])
    return lang.check("unit", folded)


def _check_json(lang: Language, text: str) -> bool:
    toks = _tokens(_JSON_TOKEN, text.lstrip("﻿"))
    folded = lang.fold([lang.mask(t) for t in toks])
    return lang.check("value", folded)


class _Python(Language):
    """Two grammars: one for logical lines, one for the order of lines in a block."""

    def __init__(self):
        super().__init__(Grammar(_PY_LINE), {}, _WORDS_PY, {"0123456789.": "NUM", "'\"": "STR"}, "_")
        self.blocks = Recognizer(Grammar(_PY_BLOCK), {"block": "stmt", "caseblock": "casestmt"})
        self.lines: dict[tuple, list] = {}

    def _mask(self, token: str) -> int:
        if token[-1] in "'\"" and len(token) > 1:
            at = next(i for i, c in enumerate(token) if c in "'\"")
            if "f" in token[:at].lower():
                quote = 3 if token[at : at + 3] in ("\'\'\'", '"""') else 1
                return self.g.bits["STR"] if self._fields(token[at + quote : -quote], 0, False) == len(token) - at - 2 * quote else BAD
            return self.g.bits["STR"]
        return super()._mask(token)

    def _fields(self, text: str, at: int, spec: bool) -> int:
        """Where the literal or format spec ends (-1: a replacement field is not valid)."""
        while at < len(text):
            c = text[at]
            if c == "}":
                if spec:
                    return at
                if text[at : at + 2] != "}}":
                    return -1
                at += 2
            elif c == "{" and text[at : at + 2] == "{{" and not spec:
                at += 2
            elif c == "{":
                end, depth, quote = at + 1, 0, ""
                while end < len(text):
                    x = text[end]
                    if quote:
                        quote = "" if x == quote else quote
                    elif x in "'\"":
                        quote = x
                    elif x in "([{":
                        depth += 1
                    elif depth and x in ")]}":
                        depth -= 1
                    elif not depth and (x in "})]:" or x == "!" and text[end + 1 : end + 2] != "="):
                        break
                    end += 1
                body = text[at + 1 : end].strip()
                if body.endswith("=") and body[-2:-1] not in ("=", "!", "<", ">", ":"):
                    body = body[:-1]
                toks = [t for t in _tokens(_PY_TOKEN, body) if t[0] != "\n"]
                try:
                    masks = [self.mask(t) for t in toks]
                    if not masks or not self.check("paren", self.fold(masks)):
                        return -1
                except Invalid:
                    return -1
                if text[end : end + 1] == "!":
                    if text[end + 1 : end + 2] not in ("r", "s", "a"):
                        return -1
                    end += 2
                if text[end : end + 1] == ":":
                    end = self._fields(text, end + 1, True)
                if end < 0 or text[end : end + 1] != "}":
                    return -1
                at = end + 1
            else:
                at += 1
        return -1 if spec else at

    def line(self, toks: list[int]) -> tuple[str | None, bool]:
        """(kind, whole): what a folded logical line is, and whether a header has its suite on the line."""
        key = tuple(toks)
        got = self.lines.get(key)
        if got is None:
            if len(self.lines) > 100_000:
                self.lines.clear()
            got = self.lines[key] = self._line(key)
        return got

    def _line(self, key: tuple) -> tuple[str | None, bool]:
        g, whole, colon = self.g, (*key, 1), self.mask(":")
        if self.rec.accepts("simple", whole):
            return "S", True
        if self.rec.accepts("decorator", whole):
            return "DEC", True
        for head in _PY_HEADS:
            ends, _ = derive(g.rules, g.index[head], whole, 0)
            for e in sorted(ends, reverse=True):
                if whole[e - 1] & colon:
                    if e == len(key):
                        return head[:-2].upper(), False
                    if head not in ("match_h",) and self.rec.accepts("simple", whole[e:]):
                        return head[:-2].upper(), True
        return None, False


def _check_python(lang: _Python, text: str) -> bool:
    toks = _tokens(_PY_TOKEN, text.lstrip("﻿") + "\n")
    masks = lang.mask
    line: list[int] = []
    depth, indent, fresh = 0, "", True
    stack = [""]
    kinds: list[list[str]] = [[]]
    needs = False  # the line before was a header without its suite
    heads: list[str] = []
    first = True
    for t in toks:
        if t[0] != "\n":
            if first:
                first = False
            m = masks(t)
            if m == BAD:
                raise Invalid("a character that starts no token")
            depth += (-5 < m < 0) - (m < -4)
            line.append(m)
            continue
        if depth > 0:
            continue
        if line:
            folded = lang.fold(line)
            kind, whole = lang.line(folded)
            if kind is None:
                raise Invalid("a line")
            if indent != stack[-1]:
                if len(indent) > len(stack[-1]) and indent.startswith(stack[-1]):
                    if not needs:
                        raise Invalid("an indent that nothing asks for")
                    stack.append(indent)
                    kinds.append([])
                else:
                    if needs:
                        raise Invalid("a block is missing")
                    while stack[-1] != indent:
                        if len(stack) == 1:
                            raise Invalid("an indent that fits no block")
                        _close(lang, kinds.pop(), heads.pop())
                        stack.pop()
            elif needs:
                raise Invalid("a block is missing")
            kinds[-1].append(kind)
            needs = not whole
            if needs:
                heads.append(kind)
            line = []
        indent = t[1:].replace("\f", "")
        depth = 0
    if depth > 0:
        raise Invalid("a bracket that is not closed")
    if needs:
        raise Invalid("a block is missing")
    while heads:
        _close(lang, kinds.pop(), heads.pop())
    return _block(lang, kinds[0], "block")


def _block(lang: _Python, kinds: list[str], name: str) -> bool:
    bits = lang.blocks.g.bits
    return lang.blocks.accepts(name, (*(bits[k] for k in kinds), 1))


def _close(lang: _Python, kinds: list[str], head: str) -> None:
    if not _block(lang, kinds, "caseblock" if head == "MATCH" else "block"):
        raise Invalid("statements in a block")


_LANGUAGES: dict[str, tuple] = {}


def _build(suffix: str) -> tuple:
    if suffix == "json":
        lang = Language(Grammar(_JSON), {}, frozenset(), {'"': "STR", "-0123456789NI": "NUM"})
        lang.masks |= {"NaN": lang.g.bits["NUM"], "Infinity": lang.g.bits["NUM"]}
        return lang, _check_json
    if suffix == "py":
        return _Python(), _check_python
    if suffix == "go":
        lang = Language(Grammar(_GO + "\nbody = NEVER\ncases = NEVER\n"), {"program": "item", "body": "bodyitem", "cases": "caseitem"}, _WORDS_GO, {"0123456789.": "NUM", '"`': "STR", "'": "CHR"}, "_")
        b = lang.g.bits
        lang.can_end = b["ID"] | b["NUM"] | b["STR"] | b["CHR"]
        for w in ("break", "continue", "fallthrough", "return", "++", "--"):
            lang.can_end |= b["'" + w]
        return lang, _check_go
    if suffix == "java":
        lists = {"unit": "item", "classbody": "member", "block": "stmt", "cases": "caseitem", "directives": "directive"}
        lang = Language(Grammar(_JAVA + "".join(f"\n{x} = NEVER" for x in ("classbody", "block", "cases", "directives"))), lists, _WORDS_JAVA, {"0123456789.": "NUM", '"': "STR", "'": "CHR"})
        return lang, _check_java
    ts = suffix == "ts"
    lists = {"program": "stmt", "body": "stmt", "cases": "caseitem", "classbody": "member"} | ({"typebody": "typemember"} if ts else {})
    lang = Language(_ecma(_TS_ONLY if ts else _JS_ONLY), lists, _WORDS_JS, {"0123456789.": "NUM", "\"'": "STR", "`": "TPL", "#": "PRIVATE"})
    b = lang.g.bits
    lang.g.bit("NL")
    lang.masks |= {"/re/": b["REGEX"]}
    lang.masks["#"] = BAD
    ends = "this super null true false return break continue debugger ++ --".split() + (["!", ">", "void", "const"] if ts else [])
    lang.can_end = _any(b[c] for c in ("ID", "NUM", "STR", "TPL", "REGEX", "PRIVATE", "NAME")) | _any(b["'" + w] for w in ends)
    lang.can_end |= _any(b[f"{k}{{{inner}}}"] for k in "PKBT" for inner in lang.g.groups[k])
    # what stands only inside of a statement or member
    on = ". ?. , : ? = => += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= == != === !== <= >= << % & | ^ && || ?? instanceof extends".split() + ([] if ts else ["<", ">"])
    lang.goes_on = _any(b.get("'" + w, 0) for w in on)
    return lang, _check_ecma


def language(suffix: str) -> tuple:
    if suffix not in _LANGUAGES:
        _LANGUAGES[suffix] = _build(suffix)
    return _LANGUAGES[suffix]


SUFFIXES = ("py", "js", "ts", "go", "java", "json")


def valid(text: str, suffix: str) -> bool:
    """Whether a dialect of the suffix's language accepts the whole text."""
    lang, check = language(suffix)
    try:
        return check(lang, text.replace("\r\n", "\n") if "\r" in text else text)
    except Invalid:
        return False
