"""Predicates and scores on the text of a block or element, and on font names. See dialect for how they are rendered."""

from __future__ import annotations

from .dialect import Engine

# Word lists, symbols and limits that decide what a text is taken for.
ADMONITIONS = ("IMPORTANT", "WARNING", "NOTE", "TIP", "CAUTION")
CODE_STARTS = ("func ", "package ", "import ", "const ", "type ", "struct ", "interface ", "return ", "else ", "range ", "# ", "kubectl ", "oc ", "docker ", "podman ", "sudo ", "apiVersion:", "kind:", "metadata:", "spec:", "status:")
CODE_PARTS = ("apiVersion:", "kind: Pod", "kind: Service", "kind: Deployment", "namespace: ", '":', "ssh-rsa ")
EQUATION_SYMBOLS = "=+−×÷∫∑∏√∂∇±≈≠≤≥∞→←↔⇒⇐⇔"
GREEK = "αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ"
TABLE_WORDS = ("name", "value", "description", "type", "size", "date", "count", "total", "average", "status")
MAIL_DOMAINS = (".edu", ".com", ".org", ".ac.", ".net")
AFFILIATIONS = ("university", "institute", "department", "laboratory", "lab", "school of", "college of", "faculty of", "centre", "center", "research", "sciences", "engineering", "computer science")
AUTHOR_MARKS = "¹²³⁴⁵†‡§∗⋆"
TITLES = ("dr.", "prof.", "ph.d", "m.d.", "mr.", "ms.", "mrs.")
MATH_FONTS = ("cmmi", "cmsy", "cmex", "msbm", "msam", "symbol", "math", "eufm", "stix", "cambria", "latinmodern", "lmmath")
MATH_SYMBOLS = "∫∑∏√∂∇±≈≠≤≥∞→←↔⇒⇐⇔∈∉⊂⊃∪∩∀∃∅αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ×÷°′″∝∴∵⊥∠∡∢"
OPERATORS = "=+-×÷<>≤≥≠≈"
ROMANS = "(I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII|XIII|XIV|XV)"


def bold_font(e: Engine, f: str) -> str:
    return e.re(f"lower({f})", "bold|black|heavy")


def italic_font(e: Engine, f: str) -> str:
    """The subset tag before '+' does not count."""
    name = e.sub(f, "^[^+]*[+]", "")
    return f"({e.re(f'lower({name})', 'italic|oblique|^cmti')} or {e.re(name, 'Ital|-(Bold|Semibold|SemiBold|Light|Medium)?It(-|$)')})"


def math_font(e: Engine, f: str) -> str:
    return e.re(f"lower({f})", "|".join(MATH_FONTS))


def styled(e: Engine, t: str, f: str) -> str:
    """Text with the marks of its font: math, else bold, else italic; blank text stays."""
    return f"case when {e.trim(t)} = '' then {t} when {math_font(e, f)} then concat('$', {t}, '$') when {bold_font(e, f)} then concat('**', {t}, '**') when {italic_font(e, f)} then concat('*', {t}, '*') else {t} end"


def fully_bold(e: Engine, t: str) -> str:
    return f"({e.n_bytes(t)} > 4 and {e.starts(t, '**')} and {e.ends(t, '**')})"


def unbolded(e: Engine, t: str) -> str:
    return f"case when {fully_bold(e, t)} then {e.trim(f'''replace({t}, '**', '')''')} else {t} end"


def page_number(e: Engine, t: str) -> str:
    """Up to three digits, alone or within dashes and spaces."""
    bare = e.trim(t)
    inner = e.sub(bare, "^[-–— ]+|[-–— ]+$", "")
    return f"({e.re(bare, '^[0-9]{1,3}$')} or {e.re(inner, '^[0-9]{1,3}$')})"


def marker(e: Engine, t: str) -> str:
    return e.group(t, "^([^ ]*) ", 1)


def rest(e: Engine, t: str) -> str:
    return e.trim(e.sub(t, "^[^ ]* ", ""))


def numbered_header(e: Engine, t: str) -> str:
    m, r = marker(e, t), rest(e, t)
    low, n = f"lower({r})", e.n_bytes(r)
    deep = e.re(m, "^[0-9][0-9]*[.][0-9.]*[0-9.]$")
    short = f"{n} between 1 and 80 and not ({e.ends(r, '.')} and {n} >= 25) and not ({e.re(low, '^(the|a|an) ')} and {n} > 40) and not ({e.re(low, ' (is|are|will|can) ')} and {n} > 35)"
    return f"({e.has(t, ' ')} and ({e.re(m, '^' + ROMANS + '[.]$')} or {deep} or ({e.re(m, '^[0-9]+[.]$')} and {short})))"


def numbered_level(e: Engine, t: str) -> str:
    m = marker(e, t)
    dots = e.count(e.sub(m, "[.]$", ""), ".")
    return f"case when {e.re(m, '^' + ROMANS + '[.]$')} then 1 else least(6, {dots} + 1) end"


def numbering_depth(e: Engine, t: str) -> str:
    """Number of dot-separated digit parts of the first word, or 0."""
    first = e.group(e.trim(t), "^([^ ]*)", 1)
    bare = e.sub(first, "[.]$", "")
    return f"case when {e.re(bare, '^[0-9]+([.][0-9]+)*$')} then {e.count(bare, '.')} + 1 else 0 end"


def caps_heading(e: Engine, t: str) -> str:
    """One to three words of two capitals or more, four letters in all, none a Roman numeral."""
    bare, up = e.trim(t), r"\p{Lu}"
    words = f"{up}{{2,}}({e.blank}+{up}{{2,}}){{0,2}}"
    roman = f"(^|{e.blank})X{{0,3}}(IX|IV|V?I{{0,3}})({e.blank}|$)"
    return f"({e.re(bare, f'^{words}$')} and not {e.re(bare, roman)} and length({e.sub(bare, e.blank, '')}) >= 4)"


def lettered_italic(e: Engine, t: str) -> str:
    return e.re(t, "^[*][A-Z][.] [^*]{1,80}[^.*][*]$")


def list_item(e: Engine, t: str) -> str:
    return e.re(e.unmarked(t), rf"^(•|- |[*] |[0-9][.] |\x5B{e.digit}+\x5D)")


def admonition(e: Engine, t: str) -> str:
    return e.re(e.unmarked(t), "^(" + "|".join(ADMONITIONS) + ")")


def code_line(e: Engine, t: str, unmarked: str | None = None) -> str:
    """unmarked: t without one leading mark, where that is at hand."""
    c = unmarked or e.unmarked(t)
    bare = e.trim(c)
    return "(" + " or ".join([
        *(e.starts(c, p) for p in CODE_STARTS), f"({e.starts(c, '$ ')} and not {e.ends(bare, '$')})", e.re(c, "^if .*[({=><!]"), e.any_of(c, CODE_PARTS),
        e.re(bare, r"^[}\x5D],"), f"({e.re(bare, r'[{\x5B]$')} and {e.has(c, ':')})", e.re(bare, r"^[{}()\x5B\x5D, ]+$"),
    ]) + ")"


def equation_number_at_end(e: Engine, t: str) -> str:
    """Digits and dots in brackets of one kind, at most ten bytes from the end."""
    return e.re(e.trim(t), r"([(][0-9.]{1,8}[)]|\x5B[0-9.]{1,8}\x5D)$")


def fraction(e: Engine, t: str) -> str:
    return e.re(t, "(^|[ $])[^ $]{1,3}/[^ $/]{1,3}([ $/]|$)")


def equation_score(e: Engine, t: str) -> str:
    dollars, low = e.count(t, "$"), f"lower({t})"
    return e.total([
        *(e.count(t, s) for s in EQUATION_SYMBOLS), f"(case when {dollars} >= 2 then {dollars} else 0 end)", f"3 * {e.number(equation_number_at_end(e, t))}",
        e.number(f"{e.any_of(t, '^_')} and not {e.any_of(t, ('http', 'www'))}"), *(e.number(e.has(t, g)) for g in GREEK), e.number(fraction(e, t)),
    ]) + " - " + e.total([*(e.number(e.has(low, w)) for w in TABLE_WORDS), f"2 * {e.number(e.count(t, '    ') + ' > 2')}"])


def author_block(e: Engine, t: str) -> str:
    low = f"lower({t})"
    parts = e.split(t, "    ")
    upper = "[A-ZÀ-ÖØ-Þ]"
    caps = e.size(e.split(e.sub("concat(' ', s)", f"{e.blank}+{upper}", "#%"), "#%"))
    words = e.size(e.split(e.trim(e.sub("s", f"{e.blank}+", " ")), " "))
    named = f"({e.size(parts)} >= 2 and " + e.exists(parts, "s", f"contains(lower(s), ' and ') and {caps} - 1 > {words} {e.div} 2") + ")"
    return "(" + " or ".join([f"({e.has(t, '@')} and {e.any_of(low, MAIL_DOMAINS)})", e.any_of(low, AFFILIATIONS), e.any_of(t, AUTHOR_MARKS), e.any_of(low, TITLES), named]) + ")"


def table_row(e: Engine, t: str, threshold: int = 2) -> str:
    """Columns set apart by gaps of four spaces (or three, twice), neither an equation nor authors, of comparable lengths and not all prose."""
    wide = e.has(t, "    ")
    parts = f"(case when {wide} then {e.split(t, '    ')} else {e.split(t, '   ')} end)"
    lens = e.each(e.tail(parts), "s", e.n_bytes(e.trim("s")))
    head = e.n_bytes(e.at(parts, 1))
    low, top = f"least({head}, {e.least_of(lens)})", f"greatest({head}, {e.most_of(lens)})"
    numbers = e.exists(parts, "s", e.re("s", f"{e.digit}{e.digit}"))
    short = e.exists(parts, "s", f"{e.n_bytes(e.trim('s'))} between 1 and 29")
    long = e.exists(parts, "s", f"{e.n_bytes(e.trim('s'))} > 40")
    return f"(({wide} or {e.count(t, '   ')} >= 2) and ({equation_score(e, t)}) < {threshold} and not {author_block(e, t)} and not ({low} > 0 and {top} > 10 * {low}) and ({numbers} or {short} or not {long}))"


def math_text(e: Engine, t: str) -> str:
    """Over 30 % symbols, or at most three characters with an operator."""
    solid = e.sub(t, e.blank, "")
    n = f"length({solid})"
    left = lambda chars: f"length(translate({solid}, '{chars}', ''))"
    return f"({n} > 0 and (({n} - {left(MATH_SYMBOLS)}) > 0.3 * {n} or ({n} <= 3 and {n} > {left(OPERATORS)})))"


def numeric_cell(e: Engine, t: str) -> str:
    return e.re(e.trim(t), "^[-+$€£]?[0-9][0-9.,]*[%]?$")


def word_gap(e: Engine, gap: str, space: str) -> str:
    return f"({gap} > 0.5 * {space})"
