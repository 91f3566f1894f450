"""Scalar expressions written once as small builders, rendered for Spark SQL or, for checks, DuckDB.

A builder takes an engine and the SQL of its arguments. Patterns use classes such as [.] instead of backslashes, so that
both engines read the same pattern.
"""

from __future__ import annotations


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Engine:
    name = ""
    bytes_fn = ""

    def n_bytes(self, x):
        return f"{self.bytes_fn}({x})"

    def count(self, x, part):
        """How often a part occurs, without overlap."""
        return f"(({self.n_bytes(x)} - {self.n_bytes(f'replace({x}, {quoted(part)}, {self.empty})')}) {self.div} {self.n_bytes(quoted(part))})"

    def has(self, x, part):
        return f"contains({x}, {quoted(part)})"

    def any_of(self, x, parts):
        return "(" + " or ".join(self.has(x, p) for p in parts) + ")"

    empty = "''"
    blank = r"[\s\p{Z}\x{85}]"
    digit = r"\p{Nd}"
    div = ""

    def number(self, condition):
        return f"(case when {condition} then 1 else 0 end)"

    def total(self, items):
        return "(" + " + ".join(items) + ")"

    def unmarked(self, t):
        """Without one leading mark of bold or italic."""
        return self.sub(t, "^([*][*]|[*])", "")

    def trim(self, t):
        """Without Unicode white space on both ends."""
        return self.sub(t, f"^{self.blank}+|{self.blank}+$", "")


#: What Java's \\s and \\p{Z} and \\x85 stand for.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


class SparkEngine(Engine):
    name, bytes_fn, div = "spark", "octet_length", "div"

    def trim(self, t):
        """Only looks at the ends, where a pattern is tried at each character."""
        return f"trim(both {quoted(WHITE)} from {t})"

    def pattern(self, p):
        return quoted(p.replace("\\", "\\\\"))

    def re(self, x, pattern):
        return f"regexp_like({x}, {self.pattern(pattern)})"

    def sub(self, x, pattern, by):
        return f"regexp_replace({x}, {self.pattern(pattern)}, {quoted(by)})"

    def group(self, x, pattern, k):
        return f"regexp_extract({x}, {self.pattern(pattern)}, {k})"

    def starts(self, x, p):
        return f"startswith({x}, {quoted(p)})"

    def ends(self, x, p):
        return f"endswith({x}, {quoted(p)})"

    def split(self, x, by):
        return f"split({x}, {quoted(by)})"

    def each(self, items, var, body):
        return f"transform({items}, {var} -> {body})"

    def exists(self, items, var, body):
        return f"exists({items}, {var} -> {body})"

    def size(self, items):
        return f"size({items})"

    def least_of(self, items):
        return f"array_min({items})"

    def most_of(self, items):
        return f"array_max({items})"

    def at(self, items, k):
        return f"element_at({items}, {k})"

    def tail(self, items):
        return f"slice({items}, 2, size({items}))"

    def join(self, items, by):
        return f"array_join({items}, {quoted(by)})"

    def pick(self, values, index):
        return f"element_at(array({', '.join(values)}), cast({index} as int) + 1)"


class DuckEngine(Engine):
    name, bytes_fn, div = "duckdb", "strlen", "//"

    def re(self, x, pattern):
        return f"regexp_matches({x}, {quoted(pattern)})"

    def sub(self, x, pattern, by):
        return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"

    def group(self, x, pattern, k):
        return f"regexp_extract({x}, {quoted(pattern)}, {k})"

    def starts(self, x, p):
        return f"starts_with({x}, {quoted(p)})"

    def ends(self, x, p):
        return f"ends_with({x}, {quoted(p)})"

    def split(self, x, by):
        return f"string_split({x}, {quoted(by)})"

    def each(self, items, var, body):
        return f"list_transform({items}, lambda {var}: {body})"

    def exists(self, items, var, body):
        return f"(len(list_filter({items}, lambda {var}: {body})) > 0)"

    def size(self, items):
        return f"len({items})"

    def least_of(self, items):
        return f"list_min({items})"

    def most_of(self, items):
        return f"list_max({items})"

    def at(self, items, k):
        return f"({items})[{k}]"

    def tail(self, items):
        return f"({items})[2:]"

    def join(self, items, by):
        return f"array_to_string({items}, {quoted(by)})"

    def pick(self, values, index):
        return f"[{', '.join(values)}][cast({index} as int) + 1]"


SPARK, DUCK = SparkEngine(), DuckEngine()
