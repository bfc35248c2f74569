"""Boolean and field queries.

Grammar, loosest first: OR, AND (also by adjacency), NOT, NEAR/k, then a leaf:
a word, a wildcard word, a word~ (fuzzy), "a phrase", field:value, field:(a OR b),
field:[low TO high], or a query in parentheses. Operators are upper-case words.

A tree becomes one boolean column per document wherever its leaves can be
decided inside a document's row, so a query is one filter over one scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from dataclasses import field as made

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.index import wildcard_regex

_TOKEN = re.compile(r'\s*(?:(?P<near>NEAR/\d+)|(?P<op>AND|OR|NOT)(?![\w:])|(?P<punct>[()\[\]])|(?P<field>[A-Za-z_]\w*):|(?P<phrase>"[^"]*")|(?P<word>[^\s()\[\]":]+))')
#: Other names of date fields.
DATE_ALIASES = {"date": "published_date", "published_at": "published_date"}


@dataclass
class Node:
    kind: str  # and, or, not, near, term, phrase, range
    value: str = ""
    field: str | None = None
    children: list[Node] = made(default_factory=list)
    low: str = ""
    high: str = ""
    distance: int = 0


class Parser:
    def __init__(self, query: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(query.rstrip()):
            m = _TOKEN.match(query, at)
            if not m:
                raise ValueError(f"can't read the query at {query[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _take(self, value: str | None = None) -> str:
        kind, got = self._peek()
        if kind == "end" or value is not None and got != value:
            raise ValueError(f"expected {value or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def parse(self) -> Node:
        node = self._any(None)
        if self._peek()[0] != "end":
            raise ValueError(f"unexpected {self._peek()[1]!r}")
        return node

    def _any(self, own: str | None) -> Node:
        parts = [self._all(own)]
        while self._peek() == ("op", "OR"):
            self._take()
            parts.append(self._all(own))
        return parts[0] if len(parts) == 1 else Node("or", children=parts)

    def _all(self, own: str | None) -> Node:
        parts = [self._not(own)]
        while self._peek()[0] != "end" and self._peek() not in (("op", "OR"), ("punct", ")"), ("punct", "]")):
            if self._peek() == ("op", "AND"):
                self._take()
            parts.append(self._not(own))
        return parts[0] if len(parts) == 1 else Node("and", children=parts)

    def _not(self, own: str | None) -> Node:
        if self._peek() == ("op", "NOT"):
            self._take()
            return Node("not", children=[self._not(own)])
        left = self._leaf(own)
        while self._peek()[0] == "near":
            k = int(self._take().partition("/")[2])
            left = Node("near", children=[left, self._leaf(own)], distance=k)
        return left

    def _leaf(self, own: str | None) -> Node:
        kind, value = self._peek()
        if (kind, value) == ("punct", "("):
            self._take()
            node = self._any(own)
            self._take(")")
            return node
        if (kind, value) == ("punct", "[") and own:
            self._take()
            low = self._take()
            self._take("TO")
            high = self._take()
            self._take("]")
            return Node("range", field=own, low=low, high=high)
        if kind == "field":
            self._take()
            return self._leaf(value)
        if kind in ("word", "phrase"):
            self._take()
            return Node("phrase", value[1:-1], own) if kind == "phrase" else Node("term", value, own)
        raise ValueError(f"unexpected {value or 'end of the query'!r}")


def parse(query: str) -> Node:
    return Parser(query).parse()


def from_conditions(conditions: list[dict], logic: str = "AND") -> Node:
    """A tree of ``{field, operator, value}`` conditions joined by one operator."""
    leaves = []
    for c in conditions:
        v = c["value"]
        leaves.append(Node("range", field=c["field"], low=str(v[0]), high=str(v[1])) if c.get("operator") == "between" else Node("term", str(v), c["field"]))
    return leaves[0] if len(leaves) == 1 else Node(logic.lower(), children=leaves)


def mode(query: str, fields: set[str]) -> str:
    """``field``, ``boolean`` or ``simple``."""
    if any(re.search(rf"(?<!\w){re.escape(f)}:", query) for f in fields):
        return "field"
    return "boolean" if re.search(r'(?<!\w)(AND|OR|NOT|NEAR/\d+)(?!\w)|"', query) else "simple"


def _joined(w: Column) -> Column:
    """The tokens, which hold no spaces, with a space on either side of each."""
    return F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))


def phrase_at(w: Column, terms: list[str]) -> Column:
    """Whether the terms stand one after another in ``w``: one search of the joined tokens."""
    return _joined(w).contains(" " + " ".join(terms) + " ")


def near(w: Column, a: str, b: str, k: int) -> Column:
    """Whether the two terms stand within k places, in either order; a term is near itself."""
    if a == b:
        return F.array_contains(w, a)
    if k < 1:
        return F.lit(False)
    gap = f"(?: [^ ]+){{0,{k - 1}}}"
    x, y = re.escape(a), re.escape(b)
    return _joined(w).rlike(f" {x}(?={gap} {y} )| {y}(?={gap} {x} )")


def within(w: Column, terms: list[str], size: int) -> Column:
    """Whether some ``size`` consecutive places hold all the terms: one pass with each term's last place."""
    terms = list(dict.fromkeys(terms))
    start = F.struct(F.lit(0).alias("i"), *[F.lit(None).cast("int").alias(f"p{k}") for k in range(len(terms))], F.lit(False).alias("found"))

    def step(s: Column, t: Column) -> Column:
        last = [F.when(t == x, s["i"]).otherwise(s[f"p{k}"]) for k, x in enumerate(terms)]
        least = F.least(*last) if len(last) > 1 else last[0]
        every = F.lit(True)
        for p in last:
            every = every & p.isNotNull()
        return F.struct((s["i"] + 1).alias("i"), *[p.alias(f"p{k}") for k, p in enumerate(last)], (s["found"] | F.coalesce(every & (s["i"] - least < size), F.lit(False))).alias("found"))

    every = F.lit(True)
    for t in terms:
        every = every & F.array_contains(w, t)
    return every & F.aggregate(w, start, step, lambda s: s["found"])


class Planner:
    """Turns trees into one boolean column over ``docs``.

    ``default``: the text column of leaves without a field. ``exact``: fields
    compared as a whole, without case. ``dates``: fields of ranges by their first
    ten characters; other ranges compare numbers.
    """

    def __init__(self, default: str = "text", exact: set[str] = frozenset(), dates: set[str] = frozenset(), fuzzy: int = 1):
        self.default, self.exact, self.dates, self.fuzzy = default, exact, dates, fuzzy

    def condition(self, node: Node) -> Column:
        own = node.field or self.default
        w = text.lexical(own)
        if node.kind in ("and", "or"):
            out = None
            for c in map(self.condition, node.children):
                out = c if out is None else out & c if node.kind == "and" else out | c
            return out
        if node.kind == "not":
            return ~self.condition(node.children[0])
        if node.kind == "near":
            a, b = node.children
            return near(text.lexical(a.field or self.default), a.value.lower(), b.value.lower(), node.distance)
        if node.kind == "range":
            own = own if own in self.dates else DATE_ALIASES.get(own, own)
            if own in self.dates:
                return F.coalesce(F.substring(F.col(own).cast("string"), 1, 10).between(node.low, node.high), F.lit(False))
            return F.coalesce(F.col(own).cast("double").between(float(node.low), float(node.high)), F.lit(False))
        value = node.value.lower()
        if own in self.exact:
            return F.coalesce(F.lower(F.col(own)) == value, F.lit(False))
        if node.kind == "phrase":
            terms = re.findall(r"[一-鿿]+|[a-z0-9]+", value)
            return phrase_at(w, terms) if terms else F.lit(False)
        if value.endswith("~"):
            return F.exists(w, lambda t: F.levenshtein(t, F.lit(value[:-1]), self.fuzzy) >= 0)
        if "*" in value or "?" in value:
            return F.exists(w, lambda t: t.rlike(wildcard_regex(value)))
        terms = re.findall(r"[一-鿿]+|[a-z0-9]+", value)
        return phrase_at(w, terms) if len(terms) > 1 else F.array_contains(w, terms[0] if terms else value)

    def matched_fields(self, node: Node) -> list[tuple[str, Column]]:
        """Each leaf's field with the leaf's own condition."""
        if node.children:
            return [x for c in node.children for x in self.matched_fields(c)]
        return [(node.field or self.default, self.condition(node))]

    def run(self, docs: DataFrame, query: str | Node) -> DataFrame:
        return docs.where(self.condition(parse(query) if isinstance(query, str) else query))


def search(docs: DataFrame, query: str, *, fields: set[str] = frozenset(), k: int = 10, planner: Planner | None = None) -> DataFrame:
    """``doc_id, score, rank``: boolean and field queries by id with score 1, simple ones by BM25."""
    from pyspark.sql import Window as W

    from tessera.operators import ranking

    if mode(query, fields) == "simple":
        return ranking.bm25(docs, re.findall(r"[一-鿿]+|[a-z0-9]+", query.lower()), k)
    found = (planner or Planner()).run(docs, query).orderBy("doc_id").limit(k)
    return found.select("doc_id", F.lit(1.0).alias("score"), F.row_number().over(W.orderBy("doc_id")).alias("rank"))


def with_matched_fields(docs: DataFrame, query: str, planner: Planner | None = None) -> DataFrame:
    """``doc_id, fields`` of the documents found, with the fields whose leaf held, those under NOT included."""
    planner = planner or Planner()
    tree = parse(query)
    fields = [F.when(c, F.lit(f)) for f, c in planner.matched_fields(tree)]
    return planner.run(docs, tree).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*fields)))), ",").alias("fields"))


def advanced(docs: DataFrame, conditions: list[dict], logic: str = "AND", *, planner: Planner | None = None, order: str = "doc_id", descending: bool = False, k: int = 20, offset: int = 0) -> DataFrame:
    """A page of the documents that meet the conditions, sorted, ties by id."""
    first = F.desc(order) if descending else F.asc(order)
    return (planner or Planner()).run(docs, from_conditions(conditions, logic)).orderBy(first, "doc_id").offset(offset).limit(k)


def field_catalogue(docs: DataFrame, planner: Planner) -> DataFrame:
    """``field, kind``: how each column can be asked for."""
    kinds = {"string": "text", "date": "date", "timestamp": "date", "timestamp_ntz": "date"}
    rows = [(c, "exact" if c in planner.exact else "date" if c in planner.dates else kinds.get(t, "multi" if t.startswith("array") else "number")) for c, t in docs.dtypes]
    return docs.sparkSession.createDataFrame(rows, "field string, kind string")


def analyse(queries: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """``query_id, normalised, terms, significant, removed, synonyms, is_boolean`` of queries ``query_id, text``."""
    w = text.lexical("text")
    stop = list(text.STOPWORDS)
    same = F.create_map(*[F.lit(x) for p in synonyms.items() for x in p]) if synonyms else None
    other = F.transform(F.filter("w", lambda t: t.isin(list(synonyms))), lambda t: same[t]) if synonyms else F.array().cast("array<string>")
    rows = queries.select("query_id", "text", w.alias("w"))
    return rows.select(
        "query_id",
        F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "\\s+", " ")).alias("normalised"),
        F.array_join("w", " ").alias("terms"),
        F.array_join(F.filter("w", lambda t: ~t.isin(stop) & (F.length(t) > 1)), " ").alias("significant"),
        F.array_join(F.filter("w", lambda t: t.isin(stop)), " ").alias("removed"),
        F.array_join(other, " ").alias("synonyms"),
        F.coalesce(F.col("text").rlike(r'\b(AND|OR|NOT)\b|"'), F.lit(False)).alias("is_boolean"),
    )
