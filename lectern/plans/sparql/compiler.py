"""The query tree as DataFrame operations; Catalyst plans the joins.

A solution column is a term: struct(v lexical value, k 'iri' or 'literal', d datatype, l language).  Patterns
that share a subject and have constant predicates become one scan of the quads and one aggregation by subject,
whatever the number of patterns.  A null condition removes a row, as a SPARQL error does.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.storage import checkpoint, stored
from lectern.schema import XSD

TERM = "struct<v:string,k:string,d:string,l:string>"
NUMERIC = [XSD + n for n in ("integer", "decimal", "float", "double", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")]


#: Shared variables that may be unbound on one side up to which rows are joined apart by which of them are.
PARTS = 3

#: Rows without a shared variable up to which they are broadcast to all that they are paired with.
FEW = 200_000


def _asks(e) -> bool:
    """Whether an expression has EXISTS in it."""
    return isinstance(e, (tuple, list)) and (bool(e) and e[0] == "exists" or any(map(_asks, e)))


@dataclass
class Sol:
    """Rows, and the variables that may be unbound in some."""

    df: DataFrame
    maybe: set[str] = field(default_factory=set)

    @property
    def vars(self) -> list[str]:
        return self.df.columns


def _flat(sol: Sol, tag: str) -> tuple[DataFrame, dict[str, tuple[Column, str]]]:
    """The rows with each term's fields as columns, and for each variable the term made of them and their prefix."""
    prefix = {v: f"{tag}{i}" for i, v in enumerate(sol.vars)}
    df = sol.df.withColumns({f"{p}_{x}": F.col(f"`{v}`")[x] for v, p in prefix.items() for x in "vkdl"})
    made = {v: F.when(F.col(f"{p}_k").isNotNull(), F.struct(*(F.col(f"{p}_{x}").alias(x) for x in "vkdl"))) for v, p in prefix.items()}
    return df, {v: (made[v], p) for v, p in prefix.items()}


@dataclass
class Val:
    """An expression's value: kind is term, bool, num or str."""

    kind: str
    col: Column


def term(v, k="literal", d=None, lang=None) -> Column:
    s = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(s(v).alias("v"), s(k).alias("k"), s(d).alias("d"), s(lang).alias("l"))


def constant(t: tuple) -> Column:
    return term(t[1], "iri") if t[0] == "iri" else term(t[1], "literal", t[2], t[3])


def number(c: Column) -> Column:
    return F.when((c["k"] == "literal") & c["d"].isin(NUMERIC), c["v"].try_cast("double"))


def numeral(c: Column) -> Column:
    """A number as a term: an integer if it is whole."""
    whole = c == F.floor(c)
    return F.when(c.isNotNull(), term(F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")), "literal", F.when(whole, F.lit(XSD + "integer")).otherwise(F.lit(XSD + "decimal"))))


def as_term(x: Val) -> Column:
    if x.kind == "term":
        return x.col
    if x.kind == "num":
        return numeral(x.col)
    if x.kind == "bool":
        return F.when(x.col.isNotNull(), term(F.when(x.col, "true").otherwise("false"), "literal", XSD + "boolean"))
    return F.when(x.col.isNotNull(), term(x.col, "literal", XSD + "string"))


def as_str(x: Val) -> Column:
    return x.col if x.kind == "str" else as_term(x)["v"]


def as_num(x: Val) -> Column:
    return x.col.cast("double") if x.kind == "num" else number(as_term(x))


def as_bool(x: Val) -> Column:
    """Effective boolean value."""
    if x.kind == "bool":
        return x.col
    if x.kind == "num":
        return x.col != 0
    if x.kind == "str":
        return x.col != ""
    c = x.col
    return F.when(c["d"] == XSD + "boolean", c["v"].isin("true", "1")).when(c["d"].isin(NUMERIC), number(c) != 0).when(c["k"] == "literal", c["v"] != "")


class Compiler:
    def __init__(self, quads: DataFrame, graph: str | None = None, dataset: dict | None = None):
        self.quads, self.default = quads, None if graph is None else [graph]
        #: Graphs that GRAPH may name; None: all.
        self.named: list[str] | None = None
        if dataset and (dataset["from"] or dataset["named"]):
            self.default, self.named = dataset["from"], dataset["named"]
        self.names: dict[str, str] = {}

    def name(self, var: str) -> str:
        """Column of a variable; Spark does not tell names apart by case."""
        return self.names.setdefault(var, f"{var}" if var.lower() not in {v.lower() for v in self.names} else f"{var}__{len(self.names)}")

    # patterns

    def solutions(self, pattern: tuple, graph: tuple | None = None) -> Sol:
        kind = pattern[0]
        if kind == "select":
            return self.select(pattern[1], graph)
        now: Sol | None = None
        filters = []
        for part in pattern[1]:
            if part[0] == "filter":
                filters.append(part[1])
            elif part[0] == "bgp":
                now = self.join(now, self.bgp(part[1], graph))
            elif part[0] == "group":
                now = self.join(now, self.solutions(part[1], graph))
            elif part[0] == "graph":
                now = self.join(now, self.solutions(part[2], part[1]))
            elif part[0] == "union":
                now = self.join(now, self.union([self.solutions(p, graph) for p in part[1]]))
            elif part[0] == "values":
                now = self.join(now, self.inline(part[1], part[2]))
            elif part[0] == "bind":
                now = now or self.unit()
                value = as_term(self.value(part[2], now))
                now = Sol(now.df.withColumn(self.name(part[1]), value), now.maybe | {self.name(part[1])})
            elif part[0] == "optional":
                inner = part[1]
                inside = [p[1] for p in inner[1] if p[0] == "filter"] if inner[0] == "join" else []
                bare = ("join", [p for p in inner[1] if p[0] != "filter"]) if inside else inner
                now = self.left(now or self.unit(), self.solutions(bare, graph), inside, graph)
            elif part[0] == "minus":
                now = self.minus(now or self.unit(), self.solutions(part[1], graph))
        now = now or self.unit()
        for f in filters:
            now = self.filter(now, f, graph)
        return now

    def unit(self) -> Sol:
        return Sol(self.quads.sparkSession.range(1).select())

    def inline(self, names: list[str], rows: list) -> Sol:
        cols = [self.name(n) for n in names]
        schema = ", ".join(f"`{c}` {TERM}" for c in cols)
        data = [tuple(None if t is None else ((t[1], "iri", None, None) if t[0] == "iri" else (t[1], "literal", t[2], t[3])) for t in row) for row in rows]
        return Sol(self.quads.sparkSession.createDataFrame(data, schema), {c for i, c in enumerate(cols) if any(r[i] is None for r in rows)})

    def scan(self, graph: tuple | None) -> DataFrame:
        """Quads in sight: s, p, o terms (and g under GRAPH ?g)."""
        q = self.quads
        obj = F.struct(F.col("object").alias("v"), F.col("object_kind").alias("k"), F.col("datatype").alias("d"), F.col("lang").alias("l")).alias("o")
        cols = [F.col("subject").alias("s"), F.col("predicate").alias("p"), obj]
        if graph and graph[0] == "var":
            seen = F.col("graph").isNotNull() if self.named is None else F.col("graph").isin(self.named)
            return q.filter(seen).select(*cols, F.col("graph").alias("g"))
        if graph:
            only = [graph[1]] if self.named is None or graph[1] in self.named else []
        else:
            only = self.default
        return q.select(*cols) if only is None else q.filter(F.col("graph").isin(only)).select(*cols)

    def bgp(self, triples: list, graph: tuple | None) -> Sol:
        stars: dict[tuple, list] = {}
        rest = []
        for s, p, o in triples:
            if p[0] == "iri" and (o[0] != "var" or o != s):
                stars.setdefault(s, []).append((p, o))
            else:
                rest.append((s, p, o))
        out: Sol | None = None
        parts = [self.star(s, po, graph) for s, po in stars.items()]
        parts += [self.path(s, p, o, graph) for s, p, o in rest]
        while parts:  # join what shares variables first
            k = next((i for i, x in enumerate(parts) if out is None or set(x.vars) & set(out.vars)), 0)
            out = self.join(out, parts.pop(k))
        return out or self.unit()

    def star(self, s: tuple, po: list, graph: tuple | None) -> Sol:
        df = self.scan(graph).filter(F.col("p").isin(sorted({p[1] for p, _ in po})))
        if s[0] == "iri":
            df = df.filter(F.col("s") == s[1])
        keys = ["s", "g"] if graph and graph[0] == "var" else ["s"]
        # a constant object is part of the scan, not of the aggregation
        if len(po) == 1:
            p, o = po[0]
            if o[0] != "var":
                df = df.filter(F.col("o").eqNullSafe(constant(o)) if o[0] == "iri" else self.same_literal(F.col("o"), o))
            df = df.select(*keys, F.col("o").alias("o0")).distinct() if not self.single_graph(graph) else df.select(*keys, F.col("o").alias("o0"))
        else:
            hits = [F.collect_set(F.when((F.col("p") == p[1]) & (F.lit(True) if o[0] == "var" else F.col("o").eqNullSafe(constant(o)) if o[0] == "iri" else self.same_literal(F.col("o"), o)), F.col("o"))).alias(f"o{i}") for i, (p, o) in enumerate(po)]
            df = df.groupBy(*keys).agg(*hits).filter(reduce(lambda a, b: a & b, [F.size(f"o{i}") > 0 for i in range(len(po))]))
            for i, (_, o) in enumerate(po):
                if o[0] == "var":
                    df = df.withColumn(f"o{i}", F.explode(f"o{i}"))
        cols: dict[str, Column] = {}
        same = []

        def bind(t: tuple, c: Column) -> None:
            if t[0] == "var":
                n = self.name(t[1])
                if n in cols:
                    same.append(c.eqNullSafe(cols[n]))
                else:
                    cols[n] = c

        bind(s, term(F.col("s"), "iri"))
        for i, (_, o) in enumerate(po):
            if o[0] == "var":
                bind(o, F.col(f"o{i}"))
        if len(keys) > 1:
            bind(graph, term(F.col("g"), "iri"))
        for c in same:
            df = df.filter(c)
        return Sol(df.select(*(c.alias(n) for n, c in cols.items())))

    def single_graph(self, graph: tuple | None) -> bool:
        return graph is not None or (self.default is not None and len(self.default) < 2)

    def same_literal(self, c: Column, t: tuple) -> Column:
        """Numbers match by value, other literals as terms; a simple string also matches without datatype."""
        if t[2] in NUMERIC:
            return number(c) == float(t[1])
        kinds = (c["d"] == t[2]) if t[2] and t[2] != XSD + "string" else F.coalesce(c["d"], F.lit(XSD + "string")) == XSD + "string"
        return (c["k"] == "literal") & (c["v"] == t[1]) & (F.lower(c["l"]) == t[3] if t[3] else c["l"].isNull() & kinds)

    def path(self, s: tuple, p: tuple, o: tuple, graph: tuple | None) -> Sol:
        """A pattern with a variable or a path in its middle."""
        if p[0] == "var":
            df = self.scan(graph).distinct()
            ends = [(s, term(F.col("s"), "iri")), (p, term(F.col("p"), "iri")), (o, F.col("o"))]
        else:
            df = self.pairs(p, graph, [t for t in (s, o) if t[0] != "var"])
            ends = [(s, F.col("a")), (o, F.col("b"))]
        if "g" in df.columns:
            ends.append((graph, term(F.col("g"), "iri")))
        cols: dict[str, Column] = {}
        for t, c in ends:
            if t[0] != "var":
                df = df.filter(c.eqNullSafe(constant(t)) if t[0] == "iri" else self.same_literal(c, t))
            elif self.name(t[1]) in cols:
                df = df.filter(c.eqNullSafe(cols[self.name(t[1])]))
            else:
                cols[self.name(t[1])] = c
        return Sol(df.select(*(c.alias(n) for n, c in cols.items())))

    def pairs(self, p: tuple, graph: tuple | None, ends: list) -> DataFrame:
        """(a, b) terms that a path connects, with g under GRAPH ?g."""
        kind = p[0]
        g = ["g"] if graph and graph[0] == "var" else []
        if kind == "iri":
            return self.scan(graph).filter(F.col("p") == p[1]).select(term(F.col("s"), "iri").alias("a"), F.col("o").alias("b"), *g).distinct()
        if kind == "inv":
            return self.pairs(p[1], graph, ends).select(F.col("b").alias("a"), F.col("a").alias("b"), *g)
        if kind == "seq":
            out = self.pairs(p[1][0], graph, ends)
            for step in p[1][1:]:
                right = self.pairs(step, graph, ends).select(F.col("a").alias("m"), F.col("b").alias("z"), *g)
                out = out.withColumnRenamed("b", "m").join(right, ["m", *g]).select("a", F.col("z").alias("b"), *g)
            return out
        if kind == "alt":
            return reduce(DataFrame.unionByName, [self.pairs(x, graph, ends) for x in p[1]])
        if kind == "not":
            ahead, back = [x[1] for x in p[1] if x[0] == "iri"], [x[1][1] for x in p[1] if x[0] == "inv"]
            edge = lambda no: self.scan(graph).filter(~F.col("p").isin(no)).select(term(F.col("s"), "iri").alias("a"), F.col("o").alias("b"), *g)
            out = edge(ahead) if ahead or not back else None
            if back:
                inv = edge(back).select(F.col("b").alias("a"), F.col("a").alias("b"), *g)
                out = inv if out is None else out.unionByName(inv)
            return out
        steps = checkpoint(self.pairs(p[1], graph, ends).distinct())
        found = steps
        if p[2] != "?":
            frontier = steps
            while not frontier.isEmpty():
                step = steps.select(F.col("a").alias("m"), F.col("b").alias("z"), *g)
                new = frontier.withColumnRenamed("b", "m").join(step, ["m", *g]).select("a", F.col("z").alias("b"), *g).distinct()
                frontier = checkpoint(new.join(found, ["a", "b", *g], "left_anti"))
                found = found.unionByName(frontier)
        if p[2] != "+":
            q = self.scan(graph)
            nodes = q.select(term(F.col("s"), "iri").alias("a"), *g).unionByName(q.select(F.col("o").alias("a"), *g))
            for t in ends:
                here = q.select(*g).distinct() if g else self.unit().df
                nodes = nodes.unionByName(here.select(constant(t).alias("a"), *g))
            found = found.unionByName(nodes.select("a", F.col("a").alias("b"), *g)).distinct()
        return found

    # combinations

    def _matched(self, left: Sol, right: Sol) -> tuple[DataFrame, Column, list[str]]:
        """(right with shared columns renamed, join condition, shared)."""
        shared = [v for v in left.vars if v in right.vars]
        renamed = right.df.select(*(F.col(f"`{v}`").alias(f"_r_{v}" if v in shared else v) for v in right.vars))
        conds = []
        for v in shared:
            a, b = left.df[f"`{v}`"], renamed[f"`_r_{v}`"]
            eq = (a["v"] == b["v"]) & (a["k"] == b["k"]) & a["d"].eqNullSafe(b["d"]) & a["l"].eqNullSafe(b["l"])
            if v in left.maybe:
                eq = eq | a.isNull()
            if v in right.maybe:
                eq = eq | b.isNull()
            conds.append(eq)
        return renamed, reduce(lambda x, y: x & y, conds) if conds else F.lit(True), shared

    def _merged(self, joined: DataFrame, left: Sol, right: Sol, shared: list[str]) -> DataFrame:
        cols = [F.coalesce(F.col(f"`{v}`"), F.col(f"`_r_{v}`")).alias(v) if v in shared and v in left.maybe else F.col(f"`{v}`") for v in left.vars]
        return joined.select(*cols, *(F.col(f"`{v}`") for v in right.vars if v not in shared))

    def parts(self, sol: Sol, other: Sol) -> list[Sol]:
        """Disjoint parts of the rows by which of the shared variables are bound; those that are not are left out.

        Within a part variables are equal or not there, so joins have hash keys.  Beyond a few such variables the
        rows stay together and are joined by a condition.  Rows that are taken apart are written once, or each part
        would make all of them anew.
        """
        loose = sorted(v for v in sol.maybe if v in sol.vars and v in other.vars)
        if not loose or len(loose) > PARTS:
            return [sol]
        out, rows = [], stored(sol.df)
        for k in range(1 << len(loose)):
            free = {v for i, v in enumerate(loose) if k >> i & 1}
            tests = [F.col(f"`{v}`").isNull() if v in free else F.col(f"`{v}`").isNotNull() for v in loose]
            df = rows.filter(reduce(lambda a, b: a & b, tests)).drop(*free)
            out.append(Sol(df, sol.maybe - set(loose)))
        return out

    def by_parts(self, left: Sol, right: Sol, how, both: bool = False) -> Sol | None:
        """The union of what ``how`` makes of the parts of both sides, or of the left side only; None if there is one of each."""
        lefts, rights = self.parts(left, right), self.parts(right, left) if both else [right]
        if len(lefts) == len(rights) == 1:
            return None
        return self.union([how(a, b) for a in lefts for b in rights])

    def product(self, part: DataFrame, other: DataFrame) -> DataFrame:
        """All pairs of the rows of a part and others.

        The planner cannot tell how few rows a part has, and takes a Cartesian product, which spills the partitions of one side
        for each of the other.  So a part is counted, and if it is small the others stream by it.
        """
        return (F.broadcast(part) if part.count() <= FEW else part).crossJoin(other)

    def join(self, left: Sol | None, right: Sol, part: bool = False) -> Sol:
        if left is None or not left.vars:
            return right if left is None else Sol(left.df.crossJoin(right.df), right.maybe)
        if not right.vars:
            return Sol(left.df.crossJoin(right.df), left.maybe)
        if (apart := self.by_parts(left, right, lambda a, b: self.join(a, b, part=True), both=True)) is not None:
            return apart
        renamed, cond, shared = self._matched(left, right)
        joined = left.df.join(renamed, cond, "inner") if shared else self.product(left.df, renamed) if part else left.df.crossJoin(renamed)
        both = {v for v in shared if v in left.maybe and v in right.maybe}
        return Sol(self._merged(joined, left, right, shared), both | {v for v in left.maybe | right.maybe if v not in shared})

    def left(self, left: Sol, right: Sol, conditions: list, graph: tuple | None) -> Sol:
        """OPTIONAL: its filters are part of the join condition and see both sides."""
        if (apart := self.by_parts(left, right, lambda a, b: self.left(a, b, conditions, graph))) is not None:
            return apart
        renamed, cond, shared = self._matched(left, right)
        cond = self._seen(left, renamed, cond, conditions)
        joined = left.df.join(renamed, cond, "left")
        return Sol(self._merged(joined, left, right, shared), left.maybe | {v for v in right.vars if v not in shared})

    def _seen(self, left: Sol, renamed: DataFrame, cond: Column, conditions: list) -> Column:
        """The join condition with filters that see the variables of both sides."""
        scope = {v: renamed[f"`{v}`"] for v in renamed.columns if not v.startswith("_r_")}
        for v in left.vars:
            other = f"_r_{v}" if f"_r_{v}" in renamed.columns else None
            scope[v] = F.coalesce(left.df[f"`{v}`"], renamed[f"`{other}`"]) if other and v in left.maybe else left.df[f"`{v}`"]
        for c in conditions:
            cond = cond & F.coalesce(as_bool(self.value(c, left, scope)), F.lit(False))
        return cond

    def minus(self, left: Sol, right: Sol) -> Sol:
        if (apart := self.by_parts(left, right, self.minus)) is not None:
            return apart
        renamed, cond, shared = self._matched(left, right)
        if not shared:
            return left
        some = reduce(lambda x, y: x | y, [left.df[f"`{v}`"].isNotNull() & renamed[f"`_r_{v}`"].isNotNull() for v in shared])
        return Sol(left.df.join(renamed, cond & some, "left_anti"), left.maybe)

    def union(self, parts: list[Sol]) -> Sol:
        every = list(dict.fromkeys(v for p in parts for v in p.vars))
        full = [p.df.select(*(F.col(f"`{v}`") if v in p.vars else F.lit(None).cast(TERM).alias(v) for v in every)) for p in parts]
        return Sol(reduce(DataFrame.unionByName, full), {v for v in every for p in parts if v not in p.vars or v in p.maybe})

    def filter(self, now: Sol, e: tuple, graph: tuple | None) -> Sol:
        if e[0] == "not" and e[1][0] == "exists":
            e = ("exists", e[1][1], not e[1][2])
        if e[0] == "exists":
            # filters of the pattern see the variables of the row that is asked for; deeper groups see their own
            parts = e[1][1] if e[1][0] == "join" else []
            inside = [p[1] for p in parts if p[0] == "filter" and not _asks(p[1])]
            bare = ("join", [p for p in parts if p[0] != "filter" or _asks(p[1])]) if inside else e[1]
            return self.matching(now, self.solutions(bare, graph), inside, e[2])
        if e[0] == "and":
            return self.filter(self.filter(now, e[1], graph), e[2], graph)
        return Sol(now.df.filter(as_bool(self.value(e, now))), now.maybe)

    def matching(self, now: Sol, inner: Sol, conditions: list, without: bool) -> Sol:
        """Rows with (or without) a match."""
        how = lambda a, b: self.matching(a, b, conditions, without)
        if (apart := self.by_parts(now, inner, how)) is not None:
            return apart
        how = "left_anti" if without else "left_semi"
        if not conditions:
            renamed, cond, _ = self._matched(now, inner)
            return Sol(now.df.join(renamed, cond, how), now.maybe)
        # fields of terms as columns of their own: the planner loses fields that both sides of such a join take from one source
        (one, mine), (two, theirs) = _flat(now, "_one"), _flat(inner, "_two")
        cond = F.lit(True)
        for v in (v for v in now.vars if v in theirs):
            same = [F.col(f"{a}_{x}").eqNullSafe(F.col(f"{b}_{x}")) for a, b in [(mine[v][1], theirs[v][1])] for x in "dl"]
            eq = (F.col(f"{mine[v][1]}_v") == F.col(f"{theirs[v][1]}_v")) & (F.col(f"{mine[v][1]}_k") == F.col(f"{theirs[v][1]}_k")) & same[0] & same[1]
            for side, sol in ((mine, now), (theirs, inner)):
                eq = eq | F.col(f"{side[v][1]}_k").isNull() if v in sol.maybe else eq
            cond = cond & eq
        scope = {v: c for v, (c, _) in {**theirs, **mine}.items()}
        for c in conditions:
            cond = cond & F.coalesce(as_bool(self.value(c, now, scope)), F.lit(False))
        return Sol(one.join(two.drop(*inner.vars), cond, how).select(*now.vars), now.maybe)

    # queries

    def select(self, q: dict, graph: tuple | None = None) -> Sol:
        now = self.solutions(q["where"], graph)
        if q["values"]:
            now = self.join(now, self.inline(*q["values"]))
        df = now.df
        aggregates: dict[str, tuple] = {}

        def lifted(e):
            """The expression with its aggregates replaced by variables."""
            if not isinstance(e, tuple):
                return [lifted(x) for x in e] if isinstance(e, list) else e
            if e and e[0] == "agg":
                n = f"_a{len(aggregates)}"
                aggregates[n] = e
                return ("var", n)
            return tuple(lifted(x) for x in e)

        chosen = None if q["vars"] is None else [(v, None if e is None else lifted(e)) for v, e in q["vars"]]
        having, order = [lifted(h) for h in q["having"]], [(lifted(e), d) for e, d in q["order"]]
        if q["group"] or aggregates:
            for v, e in q["group"]:
                if e is not None:
                    df = df.withColumn(self.name(v), as_term(self.value(e, Sol(df))))
                elif self.name(v) not in df.columns:
                    df = df.withColumn(self.name(v), F.lit(None).cast(TERM))
            keys = [F.col(f"`{self.name(v)}`") for v, _ in q["group"]]
            aggs = [self.aggregate(e, Sol(df)).alias(self.name(n)) for n, e in aggregates.items()]
            df = df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
            now = Sol(df.drop("_n"), now.maybe | set(map(self.name, aggregates)))
            for h in having:
                now = Sol(now.df.filter(as_bool(self.value(h, now))), now.maybe)
        if chosen is None:
            chosen = [(v, None) for v, c in self.names.items() if c in now.vars and not v.startswith("_")]
        for v, e in chosen:
            if e is not None:
                now = Sol(now.df.withColumn(self.name(v), as_term(self.value(e, now))), now.maybe | {self.name(v)})
            elif self.name(v) not in now.vars:
                now = Sol(now.df.withColumn(self.name(v), F.lit(None).cast(TERM)), now.maybe | {self.name(v)})
        names = list(dict.fromkeys(self.name(v) for v, _ in chosen))
        df = now.df
        sort = []
        for i, (e, down) in enumerate(order):
            c = as_term(self.value(e, now))
            rank = F.when(c.isNull(), 0).when(c["k"] == "iri", 1).otherwise(2)
            keys = {f"_s{i}r": rank, f"_s{i}n": number(c), f"_s{i}v": c["v"]}
            df = df.withColumns(keys)
            sort += [F.desc(k) if down else F.asc_nulls_first(k) for k in keys]
        if q["distinct"]:
            if sort:  # ordered after the duplicates are gone
                extra = [c for c in df.columns if c.startswith("_s") and c not in names]
                df = df.groupBy(*(F.col(f"`{n}`") for n in names)).agg(*(F.min(c).alias(c) for c in extra))
            else:
                df = df.select(*(F.col(f"`{n}`") for n in names)).distinct()
        if sort:
            df = df.orderBy(*sort)
        if q["offset"]:
            df = df.offset(q["offset"])
        if q["limit"] is not None:
            df = df.limit(q["limit"])
        return Sol(df.select(*(F.col(f"`{n}`") for n in names)), {n for n in names if n in now.maybe})

    def rows(self, q: dict) -> DataFrame:
        out = self.select(q)
        plain = {c: v for v, c in self.names.items()}
        return out.df.select(*(F.col(f"`{c}`")["v"].alias(plain[c]) for c in out.vars))

    def aggregate(self, e: tuple, now: Sol) -> Column:
        _, name, distinct, arg, sep = e
        if arg is None:
            n = F.count_distinct(*(F.col(f"`{v}`") for v in now.vars)) if distinct else F.count(F.lit(1))
            return numeral(n.cast("double"))
        x = self.value(arg, now)
        t = as_term(x)
        if name == "COUNT":
            return numeral((F.count_distinct(t) if distinct else F.count(t)).cast("double"))
        if name in ("SUM", "AVG"):
            n = as_num(x)
            total = (F.sum_distinct(n) if distinct else F.sum(n)) if name == "SUM" else F.avg(n)
            if name == "AVG" and distinct:
                total = F.sum_distinct(n) / F.count_distinct(n)
            return numeral(F.coalesce(total, F.lit(0.0)))
        if name in ("MIN", "MAX"):
            key = F.struct(F.when(t["k"] == "iri", 1).otherwise(2).alias("r"), number(t).alias("n"), t["v"].alias("v"))
            key = F.when(t.isNotNull(), key)
            return F.min_by(t, key) if name == "MIN" else F.max_by(t, key)
        if name == "SAMPLE":
            return F.any_value(t, True)
        s = as_str(x)
        joined = F.array_join(F.array_sort(F.collect_set(s) if distinct else F.collect_list(s)), sep)
        return term(joined, "literal", XSD + "string")

    # expressions

    def value(self, e: tuple, now: Sol, scope: dict[str, Column] | None = None) -> Val:
        kind = e[0]
        go = lambda x: self.value(x, now, scope)
        if kind == "var":
            n = self.name(e[1])
            if scope is not None:
                return Val("term", scope.get(n, F.lit(None).cast(TERM)))
            return Val("term", F.col(f"`{n}`") if n in now.vars else F.lit(None).cast(TERM))
        if kind in ("iri", "lit"):
            return Val("term", constant(e))
        if kind == "or":
            return Val("bool", as_bool(go(e[1])) | as_bool(go(e[2])))
        if kind == "and":
            return Val("bool", as_bool(go(e[1])) & as_bool(go(e[2])))
        if kind == "not":
            return Val("bool", ~as_bool(go(e[1])))
        if kind == "cmp":
            return Val("bool", self.compare(e[1], go(e[2]), go(e[3])))
        if kind == "in":
            return Val("bool", reduce(lambda a, b: a | b, [self.compare("=", go(e[1]), go(x)) for x in e[2]], F.lit(False)))
        if kind == "math":
            a, b = as_num(go(e[2])), as_num(go(e[3]))
            return Val("num", {"+": a + b, "-": a - b, "*": a * b, "/": F.when(b != 0, a / b)}[e[1]])
        if kind == "call":
            return self.call(e[1], e[2], go)
        raise ValueError(f"cannot be used in an expression: {kind}")

    def compare(self, op: str, a: Val, b: Val) -> Column:
        x, y = as_num(a), as_num(b)
        s, t = as_term(a), as_term(b)
        ways = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}
        both = x.isNotNull() & y.isNotNull()
        if op in ("=", "!="):
            same = (s["v"] == t["v"]) & (s["k"] == t["k"]) & F.coalesce(s["l"], F.lit("")).eqNullSafe(F.coalesce(t["l"], F.lit(""))) & (F.coalesce(s["d"], F.lit(XSD + "string")) == F.coalesce(t["d"], F.lit(XSD + "string")))
            same = F.when(s.isNotNull() & t.isNotNull(), same)
            return F.when(both, ways[op](x, y)).otherwise(same if op == "=" else ~same)
        lexical = F.when((s["k"] == "literal") & (t["k"] == "literal") & x.isNull() & y.isNull(), ways[op](s["v"], t["v"]))
        return F.when(both, ways[op](x, y)).otherwise(lexical)

    def call(self, name: str, args: list, go) -> Val:
        if name == "BOUND":
            return Val("bool", go(args[0]).col.isNotNull())
        if name == "COALESCE":
            return Val("term", F.coalesce(*(as_term(go(x)) for x in args)))
        if name == "IF":
            return Val("term", F.when(as_bool(go(args[0])), as_term(go(args[1]))).when(~as_bool(go(args[0])), as_term(go(args[2]))))
        x = [go(a) for a in args]
        s = [as_str(v) for v in x]
        text = {
            "STR": lambda: s[0], "LCASE": lambda: F.lower(s[0]), "UCASE": lambda: F.upper(s[0]), "CONCAT": lambda: F.concat(*s),
            "STRBEFORE": lambda: F.when(F.instr(s[0], s[1]) > 0, F.substring(s[0], F.lit(1), F.instr(s[0], s[1]) - 1)).otherwise(""),
            "STRAFTER": lambda: F.when(F.instr(s[0], s[1]) > 0, F.substring(s[0], F.instr(s[0], s[1]) + F.length(s[1]), F.length(s[0]))).otherwise(""),
            "SUBSTR": lambda: F.substring(s[0], as_num(x[1]).cast("int"), as_num(x[2]).cast("int") if len(x) > 2 else F.length(s[0])),
            "REPLACE": lambda: F.regexp_replace(s[0], s[1], s[2]), "ENCODE_FOR_URI": lambda: F.regexp_replace(F.url_encode(s[0]), r"\+", "%20"),
            "MD5": lambda: F.md5(s[0]), "SHA1": lambda: F.sha1(s[0]), "SHA256": lambda: F.sha2(s[0], 256), "SHA384": lambda: F.sha2(s[0], 384), "SHA512": lambda: F.sha2(s[0], 512),
            "LANG": lambda: F.when(as_term(x[0])["k"] == "literal", F.coalesce(as_term(x[0])["l"], F.lit(""))), "STRUUID": lambda: F.uuid(), "TZ": lambda: F.regexp_extract(s[0], r"(Z|[+-]\d\d:\d\d)$", 1),
        }
        if name in text:
            return Val("str", text[name]())
        logic = {
            "CONTAINS": lambda: s[0].contains(s[1]), "STRSTARTS": lambda: s[0].startswith(s[1]), "STRENDS": lambda: s[0].endswith(s[1]),
            "REGEX": lambda: F.regexp_like(s[0], F.concat(F.concat(F.lit("(?"), s[2], F.lit(")")), s[1]) if len(s) > 2 else s[1]),
            "LANGMATCHES": lambda: F.when(s[1] == "*", s[0] != "").otherwise((F.lower(s[0]) == F.lower(s[1])) | F.startswith(F.lower(s[0]), F.concat(F.lower(s[1]), F.lit("-")))),
            "ISIRI": lambda: as_term(x[0])["k"] == "iri", "ISURI": lambda: as_term(x[0])["k"] == "iri", "ISLITERAL": lambda: as_term(x[0])["k"] == "literal", "ISBLANK": lambda: as_term(x[0]).isNotNull() & F.lit(False),
            "ISNUMERIC": lambda: F.when(as_term(x[0]).isNotNull(), as_num(x[0]).isNotNull()), "SAMETERM": lambda: as_term(x[0]).eqNullSafe(as_term(x[1])),
        }
        if name in logic:
            return Val("bool", logic[name]())
        when = lambda: F.try_to_timestamp(s[0])
        maths = {
            "STRLEN": lambda: F.length(s[0]), "ABS": lambda: F.abs(as_num(x[0])), "CEIL": lambda: F.ceil(as_num(x[0])), "FLOOR": lambda: F.floor(as_num(x[0])), "ROUND": lambda: F.floor(as_num(x[0]) + 0.5), "RAND": lambda: F.rand(),
            "YEAR": lambda: F.year(when()), "MONTH": lambda: F.month(when()), "DAY": lambda: F.dayofmonth(when()), "HOURS": lambda: F.hour(when()), "MINUTES": lambda: F.minute(when()), "SECONDS": lambda: F.second(when()),
        }
        if name in maths:
            return Val("num", maths[name]().cast("double"))
        if name == "NOW":
            return Val("term", term(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "literal", XSD + "dateTime"))
        if name == "DATATYPE":
            t = as_term(x[0])
            return Val("term", F.when(t["k"] == "literal", term(F.coalesce(t["d"], F.lit(XSD + "string")), "iri")))
        if name in ("IRI", "URI"):
            return Val("term", F.when(s[0].isNotNull(), term(s[0], "iri")))
        if name == "UUID":
            return Val("term", term(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri"))
        if name == "STRDT":
            return Val("term", term(s[0], "literal", s[1]))
        if name == "STRLANG":
            return Val("term", term(s[0], "literal", None, s[1]))
        if name.startswith("CAST:"):
            kind = name[5:]
            if kind in NUMERIC:
                n = s[0].try_cast("double")
                return Val("num", F.floor(n) if kind.endswith("nteger") else n)
            if kind == XSD + "boolean":
                return Val("bool", s[0].isin("true", "1"))
            return Val("term", F.when(s[0].isNotNull(), term(s[0], "literal", kind)))
        raise ValueError(f"unknown function {name}")
