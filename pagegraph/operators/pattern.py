"""Graph patterns as DataFrame operations.

``Graph.match`` scans triples, ``Solutions`` combines what was found. A variable is a column: a
plain string when it can only hold an address (subjects, predicates, joined objects), else a term
struct. Joins on addresses therefore use the graph's own ``s`` column, so a table bucketed by
``s`` joins without a shuffle. Nothing is hinted; sizes decide the join strategy at run time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import fixed, terms
from pagegraph.session import checkpointed


@dataclass(frozen=True)
class Lit:
    """Literal constant of a pattern."""

    value: str
    datatype: str | None = None
    lang: str | None = None

    def __post_init__(self):
        # a plain string and one typed xsd:string are the same term; graphs store it without datatype
        if self.datatype == fixed.XSD_STRING:
            object.__setattr__(self, "datatype", None)


@dataclass(frozen=True)
class Path:
    """Property path: a predicate, or ``seq``, ``alt``, ``inv``, ``opt``, ``star``, ``plus`` of paths."""

    kind: str
    parts: tuple


def seq(*parts):
    return Path("seq", parts)


def alt(*parts):
    return Path("alt", parts)


def inv(part):
    return Path("inv", (part,))


def opt(part):
    return Path("opt", (part,))


def star(part):
    return Path("star", (part,))


def plus(part):
    return Path("plus", (part,))


def _inverses_inward(path: Path | str, flip: bool = False) -> Path | str:
    """The same path with inverses on predicates only."""
    if isinstance(path, str):
        return inv(path) if flip else path
    if path.kind == "inv":
        return _inverses_inward(path.parts[0], not flip)
    parts = tuple(_inverses_inward(part, flip) for part in path.parts)
    return Path(path.kind, parts[::-1] if flip and path.kind == "seq" else parts)


def _is_var(x) -> bool:
    return isinstance(x, str) and x.startswith("?")


def address_term(value: Column) -> Column:
    kind = F.when(F.startswith(value, F.lit("_:")), F.lit("bnode")).otherwise(F.lit("iri"))
    return F.when(value.isNotNull(), terms.term(kind, value))


def object_term() -> Column:
    return terms.term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))


def _not_literal() -> Column:
    return F.col("o_kind").isin("iri", "bnode")


class Graph:
    """Triples with the graph columns; one or many datasets."""

    def __init__(self, df: DataFrame):
        self.df = df

    def dataset(self, *ids: str) -> Graph:
        return Graph(self.df.where(F.col("dataset_id").isin(*ids)))

    def match(self, s, p, o, address: bool = False) -> Solutions:
        """Triple pattern. ``?x`` is a variable, ``None`` an anonymous node, a string an address,
        :class:`Lit` a literal. ``address`` keeps only address objects and stores them as text.
        """
        df = self.df
        for column, want in (("s", s), ("p", p)):
            if want is not None and not _is_var(want):
                df = df.where(F.col(column) == want)
        if isinstance(o, Lit):
            df = df.where((F.col("o_kind") == "literal") & (F.col("o") == o.value))
            for column, want in (("o_dt", o.datatype), ("o_lang", o.lang)):
                df = df.where(F.col(column).isNull() if want is None else F.col(column) == want)
        elif o is not None and not _is_var(o):
            df = df.where((F.col("o_kind") != "literal") & (F.col("o") == o))
        columns: dict[str, Column] = {}
        addresses: set[str] = set()
        for column, want in (("s", s), ("p", p)):
            if _is_var(want):
                name = want[1:]
                if name in columns:
                    df = df.where(F.col(column) == columns[name])
                columns[name] = F.col(column)
                addresses.add(name)
        if _is_var(o):
            name = o[1:]
            if name in columns:
                df = df.where(_not_literal() & (F.col("o") == columns[name]))
            elif address:
                df = df.where(_not_literal())
                columns[name] = F.col("o")
                addresses.add(name)
            else:
                columns[name] = object_term()
        out = df.select(*[c.alias(n) for n, c in columns.items()]) if columns else df.select(F.lit(1).alias("_hit"))
        return Solutions(out, certain=set(columns), addresses=addresses)

    def path(self, s, path: Path | str, o) -> Solutions:
        """Property path between two variables or constants; pairs are distinct for ``*`` and ``+``.

        A constant start is followed forwards, a constant end backwards, and every part goes on from
        the rows reached so far. Only a path that begins open on both sides with a closure builds the
        closure of the whole graph, which is then its result.
        """
        path = _inverses_inward(path)
        if s is not None and not _is_var(s):
            pairs = self._onward(path, self._at(s))
            if o is not None and not _is_var(o):
                pairs = pairs.where((F.col("b.kind") != "literal") & (F.col("b.value") == o))
        elif o is not None and not _is_var(o):
            back = self._onward(_inverses_inward(inv(path)), self._at(o))
            pairs = back.select(F.col("b").alias("a"), F.col("a").alias("b"))
        else:
            pairs = self._pairs(path)
        if _is_var(s) and s == o:
            pairs = pairs.where(F.col("a") == F.col("b"))
        columns = {x[1:]: F.col(c) for c, x in (("a", s), ("b", o)) if _is_var(x)}
        out = pairs.select(*[c.alias(n) for n, c in columns.items()]) if columns else pairs.select(F.lit(1).alias("_hit"))
        return Solutions(out, certain=set(columns), addresses=set())

    def _at(self, address: str) -> DataFrame:
        """The one pair of a constant with itself."""
        one = self.df.sparkSession.range(1).select(address_term(F.lit(address)).alias("a"))
        return one.select("a", F.col("a").alias("b"))

    def _edges(self, step: Path | str) -> DataFrame:
        """(a, b) of a predicate or its inverse."""
        flip = not isinstance(step, str)
        found = self.df.where(F.col("p") == (step.parts[0] if flip else step))
        ends = address_term(F.col("s")), object_term()
        return found.select(ends[flip].alias("a"), ends[not flip].alias("b"))

    def _nodes(self) -> DataFrame:
        """All terms in subject or object place."""
        return (
            self.df.select(address_term(F.col("s")).alias("a")).unionByName(self.df.select(object_term().alias("a"))).distinct()
        )

    def _onward(self, path: Path | str, reached: DataFrame) -> DataFrame:
        """Pairs (a, b) after ``path`` from the pairs reached so far."""
        if isinstance(path, str) or path.kind == "inv":
            steps = self._edges(path).select(F.col("a").alias("_m"), F.col("b").alias("_b"))
            return reached.withColumnRenamed("b", "_m").join(steps, "_m").select("a", F.col("_b").alias("b"))
        if path.kind == "seq":
            for part in path.parts:
                reached = self._onward(part, reached)
            return reached
        if path.kind == "alt":
            out = self._onward(path.parts[0], reached)
            for part in path.parts[1:]:
                out = out.unionByName(self._onward(part, reached))
            return out
        if path.kind == "opt":
            return reached.unionByName(self._onward(path.parts[0], reached)).distinct()
        first = reached if path.kind == "star" else self._onward(path.parts[0], reached)
        return self._closure(path.parts[0], first)

    def _pairs(self, path: Path | str) -> DataFrame:
        """All pairs of a path that is open on both sides."""
        if isinstance(path, str) or path.kind == "inv":
            return self._edges(path)
        if path.kind == "seq":
            return self._onward(Path("seq", path.parts[1:]), self._pairs(path.parts[0]))
        if path.kind == "alt":
            out = self._pairs(path.parts[0])
            for part in path.parts[1:]:
                out = out.unionByName(self._pairs(part))
            return out
        own = self._nodes().select("a", F.col("a").alias("b"))
        if path.kind == "opt":
            return self._pairs(path.parts[0]).unionByName(own).distinct()
        closed = self._closure(path.parts[0], self._pairs(path.parts[0]))
        return closed.unionByName(own).distinct() if path.kind == "star" else closed

    def _closure(self, part: Path | str, first: DataFrame) -> DataFrame:
        """Pairs reached from ``first`` by any number of further steps.

        Each round goes on from the pairs that are new, drops those already known and cuts lineage; it
        ends when a round brings nothing, so a cycle ends too. Where that takes more than ``PLAIN`` rounds
        longer strides are laid beside the steps, see :class:`_Strides`, so chains and rings need rounds
        in proportion to the logarithm of their length.
        """
        frontier = checkpointed(first.distinct())
        known, strides, rounds = frontier, None, 0
        while not frontier.isEmpty():
            grown = self._onward(part, frontier) if strides is None else _joined(frontier, strides.all)
            frontier = checkpointed(grown.distinct().join(known, ["a", "b"], "left_anti"))
            known = known.unionByName(frontier)
            rounds += 1
            if rounds >= PLAIN and not _has_closure(part):
                strides = (strides or _Strides(self._pairs(part))).longer()
        return known


#: rounds a closure goes on by single steps; pairs of a stride, as a multiple of the single steps
PLAIN, STRIDE_PAIRS = 4, 2


def _has_closure(path: Path | str) -> bool:
    return not isinstance(path, str) and (path.kind in ("star", "plus") or any(_has_closure(p) for p in path.parts))


def _joined(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    onward = steps.select(F.col("a").alias("_m"), F.col("b").alias("_b"))
    return pairs.withColumnRenamed("b", "_m").join(onward, "_m").select("a", F.col("_b").alias("b"))


class _Strides:
    """Single steps, pairs two steps apart, four, eight, and so on, while such pairs stay few.

    On chains, rings and trees towards their root a node has few pairs at any distance. Where paths
    branch out the pairs of the next stride, counted from the steps into and out of every node before
    anything is joined, would be many; then the strides at hand do, as few rounds are left there.
    """

    def __init__(self, steps: DataFrame):
        self.last = checkpointed(steps.where("a <> b").distinct())
        self.all, self.most = self.last, STRIDE_PAIRS * self.last.count()

    def longer(self) -> _Strides:
        into = self.last.groupBy(F.col("b").alias("n")).agg(F.count("*").alias("x"))
        out = self.last.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("y"))
        pairs = into.join(out, "n").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0))).first()[0]
        if 0 < pairs <= self.most:
            self.last = checkpointed(_joined(self.last, self.last).where("a <> b").distinct())
            self.all = self.all.unionByName(self.last)
        return self


class Solutions:
    """Solution rows. ``certain`` variables are bound in every row, ``maybe`` ones may be unbound."""

    def __init__(
        self, df: DataFrame, certain: Iterable[str] = (), maybe: Iterable[str] = (), addresses: Iterable[str] = ()
    ):
        self.df = df
        self.certain = set(certain)
        self.maybe = set(maybe)
        self.addresses = set(addresses)

    @property
    def variables(self) -> list[str]:
        return [c for c in self.df.columns if c in self.certain | self.maybe]

    def _with(self, df: DataFrame, **changes) -> Solutions:
        state = {"certain": self.certain, "maybe": self.maybe, "addresses": self.addresses} | changes
        return Solutions(df, **state)

    # --- access ---------------------------------------------------------------------------------

    def term(self, name: str) -> Column:
        return address_term(F.col(name)) if name in self.addresses else F.col(name)

    def value(self, name: str) -> Column:
        return F.col(name) if name in self.addresses else F.col(name)["value"]

    def terms(self) -> DataFrame:
        """Every variable as a term struct."""
        return self.df.select(*[self.term(v).alias(v) for v in self.variables])

    def values(self, *names: str) -> DataFrame:
        """Lexical values of the named (or all) variables."""
        return self.df.select(*[self.value(v).alias(v) for v in (names or self.variables)])

    def as_address(self, *names: str) -> Solutions:
        """Store variables as addresses; rows where one holds a literal drop out."""
        df = self.df
        for name in names:
            if name not in self.addresses:
                df = df.where(F.col(name)["kind"] != "literal").withColumn(name, F.col(name)["value"])
        return self._with(df, addresses=self.addresses | set(names))

    def as_terms(self, *names: str) -> Solutions:
        df = self.df
        for name in names:
            if name in self.addresses:
                df = df.withColumn(name, address_term(F.col(name)))
        return self._with(df, addresses=self.addresses - set(names))

    # --- joins ----------------------------------------------------------------------------------

    def _aligned(self, other: Solutions) -> tuple[Solutions, Solutions]:
        """Give shared variables one representation: an address on either side makes both one.

        Only a side that keeps its rows may drop literals, so a possibly unbound or outer variable
        is widened to a term instead.
        """
        left, right = self, other
        for name in set(self.variables) & set(other.variables):
            if (name in left.addresses) == (name in right.addresses):
                continue
            left, right = left.as_terms(name), right.as_terms(name)
        return left, right

    def _patterns(self, names: set[str]) -> list[tuple[DataFrame, set[str]]]:
        """Split the rows by which of the possibly unbound ``names`` are bound."""
        loose = sorted(names & self.maybe)
        out = []
        for size in range(len(loose) + 1):
            for unbound in combinations(loose, size):
                df = self.df
                for name in loose:
                    df = df.where(F.col(name).isNull() if name in unbound else F.col(name).isNotNull())
                out.append((df, names - set(unbound)))
        return out

    @staticmethod
    def _need_key(keys: set[str]) -> list[str]:
        if not keys:
            raise ValueError("the two sides share no bound variable: that would pair every row with every row")
        return sorted(keys)

    def join(self, other: Solutions) -> Solutions:
        """Compatible pairs. Possibly unbound shared variables are split off by case, so that
        every case is an equality join.
        """
        shared = set(self.variables) & set(other.variables)
        both_certain = shared <= self.certain and shared <= other.certain
        if both_certain:
            left, right = self._narrowed(other, shared)
            df = left.df.join(right.df, self._need_key(shared))
            return Solutions(
                df,
                left.certain | right.certain,
                (left.maybe | right.maybe) - left.certain - right.certain,
                left.addresses | right.addresses,
            )
        left, right = self._aligned(other)
        columns = left.variables + [v for v in right.variables if v not in left.variables]
        out = None
        for ldf, lbound in left._patterns(shared):
            for rdf, rbound in right._patterns(shared):
                keys = self._need_key(lbound & rbound)
                rest = [v for v in right.variables if v not in keys and v in shared]
                renamed = rdf
                for name in rest:
                    renamed = renamed.withColumnRenamed(name, "_r_" + name)
                part = ldf.join(renamed, keys)
                part = part.select(
                    *[F.coalesce(F.col(v), F.col("_r_" + v)).alias(v) if v in rest else F.col(v) for v in columns]
                )
                out = part if out is None else out.unionByName(part)
        certain = left.certain | right.certain
        return Solutions(out, certain, set(columns) - certain, left.addresses | right.addresses)

    def _narrowed(self, other: Solutions, shared: set[str]) -> tuple[Solutions, Solutions]:
        """For inner joins: an address on one side turns the other side's variable into one."""
        left, right = self, other
        for name in shared:
            if name in left.addresses and name not in right.addresses:
                right = right.as_address(name)
            elif name in right.addresses and name not in left.addresses:
                left = left.as_address(name)
        return left, right

    def optional(self, other: Solutions, condition: Callable[[Solutions], Column] | None = None) -> Solutions:
        """Left outer join; ``condition`` is the filter inside the optional part.

        Rows in which all shared variables are unbound stay as they are. The standard would pair each
        of them with every row of the optional part; chained optional parts on a variable of an
        earlier one mean the former.
        """
        shared = set(self.variables) & set(other.variables)
        left, right = self, other
        for name in shared:
            if name in left.addresses and name not in right.addresses:
                right = right.as_address(name)
            elif name in right.addresses and name not in left.addresses:
                left = left.as_terms(name)
                right = right.as_terms(name)
        if not shared <= right.certain:
            return left._optional_by_case(right, shared, condition)
        fresh = [v for v in right.variables if v not in shared]
        columns = left.variables + fresh
        out = None
        for ldf, lbound in left._patterns(shared):
            keys = sorted(lbound & shared) if shared else self._need_key(shared)
            if not keys:
                kinds = {f.name: f.dataType for f in right.df.schema.fields}
                part = ldf.select(*left.variables, *[F.lit(None).cast(kinds[v]).alias(v) for v in fresh])
                out = part if out is None else out.unionByName(part)
                continue
            renamed = right.df
            for name in shared:
                renamed = renamed.withColumnRenamed(name, "_r_" + name)
            on = F.lit(True)
            for name in keys:
                on = on & (F.col(name) == F.col("_r_" + name))
            if condition is not None:
                seen = Solutions(left.df, left.certain | right.certain, left.maybe, left.addresses | right.addresses)
                on = on & condition(seen)
            part = ldf.join(renamed, on, "left").select(
                *[
                    F.coalesce(F.col(v), F.col("_r_" + v)).alias(v) if v in shared and v not in keys else F.col(v)
                    for v in columns
                ]
            )
            out = part if out is None else out.unionByName(part)
        return Solutions(out, left.certain, left.maybe | set(fresh), left.addresses | right.addresses)

    def _optional_by_case(self, right: Solutions, shared: set[str], condition: Callable[[Solutions], Column] | None) -> Solutions:
        """Left outer join where shared variables may be unbound on both sides.

        Left rows get a number. Each pair of cases, by which shared variables are bound, is an equality
        join on those bound on both sides; a variable bound on one side only takes that value. Rows whose
        number is in no join stay, with the optional part unbound. Two rows that share no bound variable
        are no pair.
        """
        fresh = [v for v in right.variables if v not in shared]
        numbered = checkpointed(self.df.withColumn("_row", F.monotonically_increasing_id()))
        names = self.variables + fresh
        found = None
        for ldf, lbound in self._with(numbered)._patterns(shared):
            for rdf, rbound in right._patterns(shared):
                keys = sorted(lbound & rbound)
                if not keys:
                    continue
                renamed = rdf
                for name in shared:
                    renamed = renamed.withColumnRenamed(name, "_r_" + name)
                on = F.lit(True)
                for name in keys:
                    on = on & (F.col(name) == F.col("_r_" + name))
                both = ldf.join(renamed, on)
                merged = [F.coalesce(F.col(v), F.col("_r_" + v)).alias(v) if v in shared else F.col(v) for v in names]
                part = both.select("_row", *merged)
                if condition is not None:
                    part = part.where(condition(Solutions(part, self.certain | right.certain, self.maybe | right.maybe, self.addresses | right.addresses)))
                found = part if found is None else found.unionByName(part)
        if found is None:
            self._need_key(set())
        found = checkpointed(found)
        kinds = {f.name: f.dataType for f in right.df.schema.fields}
        alone = numbered.join(found.select("_row").distinct(), "_row", "left_anti")
        alone = alone.select(*self.variables, *[F.lit(None).cast(kinds[v]).alias(v) for v in fresh])
        return Solutions(found.drop("_row").unionByName(alone), self.certain, self.maybe | set(fresh), self.addresses | right.addresses)

    def minus(self, other: Solutions) -> Solutions:
        """Drop rows compatible with a row of ``other`` that shares a bound variable.

        Without a shared variable nothing is dropped.
        """
        shared = set(self.variables) & set(other.variables)
        if not shared:
            return self
        left, right = self._aligned(other)
        out = None
        for ldf, lbound in left._patterns(shared):
            for rdf, rbound in right._patterns(shared):
                keys = sorted(lbound & rbound)
                if keys:
                    ldf = ldf.join(rdf.select(*keys).distinct(), keys, "left_anti")
            out = ldf if out is None else out.unionByName(ldf)
        return left._with(out)

    def exists(self, other: Solutions, negate: bool = False, condition: Callable[[Solutions], Column] | None = None) -> Solutions:
        """FILTER [NOT] EXISTS on the shared variables, with an optional condition over both sides."""
        shared = set(self.variables) & set(other.variables)
        if not shared <= self.certain or not shared <= other.certain:
            raise ValueError("shared variables of an existence test must be bound on both sides")
        left, right = self._aligned(other)
        renamed = right.df
        for name in shared:
            renamed = renamed.withColumnRenamed(name, "_r_" + name)
        on = F.lit(True)
        for name in self._need_key(shared):
            on = on & (F.col(name) == F.col("_r_" + name))
        if condition is not None:
            on = on & condition(Solutions(left.df, left.certain | right.certain, (), left.addresses | right.addresses))
        return left._with(left.df.join(renamed, on, "left_anti" if negate else "left_semi"))

    # --- rows -----------------------------------------------------------------------------------

    def filter(self, condition: Callable[[Solutions], Column] | Column) -> Solutions:
        """Keep rows where the condition holds; an error counts as false (null)."""
        test = condition(self) if callable(condition) else condition
        return self._with(self.df.where(test))

    def bind(self, name: str, value: Callable[[Solutions], Column] | Column, certain: bool = False) -> Solutions:
        """New variable from a term column; an error leaves it unbound (null)."""
        column = value(self) if callable(value) else value
        known = {"certain": self.certain | {name}} if certain else {"maybe": self.maybe | {name}}
        return self._with(self.df.withColumn(name, column), **known)

    def union(self, other: Solutions) -> Solutions:
        """Rows of both; variables one side lacks are unbound there."""
        left, right = self._aligned(other)
        df = left.df.unionByName(right.df, allowMissingColumns=True)
        certain = left.certain & right.certain
        every = set(left.variables) | set(right.variables)
        return Solutions(df, certain, every - certain, left.addresses | right.addresses)

    def values_join(self, names: Sequence[str], rows: Sequence[Sequence[str | Lit]]) -> Solutions:
        """Join with inline data; strings are addresses."""
        return self.join(inline(self.df.sparkSession, names, rows))

    def project(self, *names: str) -> Solutions:
        kept = set(names)
        return Solutions(self.df.select(*names), self.certain & kept, self.maybe & kept, self.addresses & kept)

    def rename(self, **names: str) -> Solutions:
        df = self.df
        for old, new in names.items():
            df = df.withColumnRenamed(old, new)
        swap = lambda group: {names.get(v, v) for v in group}
        return Solutions(df, swap(self.certain), swap(self.maybe), swap(self.addresses))

    def distinct(self) -> Solutions:
        return self._with(self.df.distinct())

    def order_by(self, *order: Column) -> Solutions:
        """Ascending puts unbound first, descending last."""
        return self._with(self.df.orderBy(*order))

    def limit(self, count: int) -> Solutions:
        return self._with(self.df.limit(count))

    def offset(self, count: int) -> Solutions:
        return self._with(self.df.offset(count))

    # --- results --------------------------------------------------------------------------------

    def group(self, by: Sequence[str], having: Column | None = None, as_terms: bool = False, **aggregates: Column) -> DataFrame:
        """Aggregates per group as plain columns; ``having`` refers to their names.

        Groups are terms: one spelling under two datatypes or languages is two groups. The group
        columns are lexical values, or term structs with ``as_terms``.
        """
        columns = [agg.alias(name) for name, agg in aggregates.items()]
        grouped = self.df.groupBy(*by).agg(*columns)
        grouped = grouped if having is None else grouped.where(having)
        if as_terms:
            return grouped.select(*[self.term(v).alias(v) for v in by], *aggregates)
        return grouped.select(*[self.value(v).alias(v) for v in by], *aggregates)

    def order_terms(self, *names: str, descending: Iterable[str] = ()) -> Solutions:
        """Term order: unbound, blank nodes, addresses, literals; numbers and times by value."""
        falling = set(descending)
        keys = [terms.order_key(self.term(n)) for n in names]
        return self._with(self.df.orderBy(*[k.desc() if n in falling else k.asc() for n, k in zip(names, keys)]))

    def ask(self) -> DataFrame:
        """One row: whether there is any solution."""
        return self.df.select(F.lit(1).alias("_hit")).limit(1).agg((F.count("_hit") > 0).alias("answer"))

    def construct(self, dataset_id: str, templates: Sequence[tuple]) -> DataFrame:
        """Graph with one triple per template and solution; a triple with an unbound part is skipped."""

        def part(x) -> Column:
            if _is_var(x):
                return self.term(x[1:])
            if isinstance(x, Lit):
                return terms.literal(x.value, x.datatype, x.lang)
            return terms.iri(x)

        made = F.array(
            *[F.struct(part(s).alias("s"), part(p).alias("p"), part(o).alias("o")) for s, p, o in templates]
        )
        good = F.filter(
            made,
            lambda t: t["s"].isNotNull()
            & (t["s"]["kind"] != "literal")
            & t["p"].isNotNull()
            & (t["p"]["kind"] == "iri")
            & t["o"].isNotNull(),
        )
        return (
            self.df.select(F.explode(good).alias("_t"))
            .select(
                F.lit(dataset_id).alias("dataset_id"),
                F.col("_t.s.value").alias("s"),
                F.col("_t.p.value").alias("p"),
                F.col("_t.o.kind").alias("o_kind"),
                F.col("_t.o.value").alias("o"),
                F.col("_t.o.datatype").alias("o_dt"),
                F.col("_t.o.lang").alias("o_lang"),
            )
            .dropDuplicates()
        )

    def describe(self, graph: Graph, name: str) -> DataFrame:
        """Triples whose subject is a value of the variable."""
        wanted = self.as_address(name).df.select(F.col(name).alias("s")).distinct()
        return graph.df.join(wanted, "s", "left_semi").select(*graph.df.columns)


def inline(spark, names: Sequence[str], rows: Sequence[Sequence[str | Lit]]) -> Solutions:
    """VALUES: a small table of constants."""
    addresses = {n for i, n in enumerate(names) if all(isinstance(row[i], str) for row in rows)}
    data = [
        tuple(
            cell
            if name in addresses
            else ((("literal", cell.value, cell.datatype, cell.lang)) if isinstance(cell, Lit) else ("iri", cell, None, None))
            for name, cell in zip(names, row)
        )
        for row in rows
    ]
    kind = "struct<kind:string,value:string,datatype:string,lang:string>"
    schema = ", ".join("`{}` {}".format(n, "string" if n in addresses else kind) for n in names)
    return Solutions(spark.createDataFrame(data, schema), certain=set(names), addresses=addresses)


# --- aggregate expressions: an empty group counts zero ------------------------------------------


def count(value: Column | None = None) -> Column:
    return F.count(F.lit(1)) if value is None else F.count(value)


def count_distinct(value: Column) -> Column:
    return F.count_distinct(value)


def total(number: Column) -> Column:
    return F.coalesce(F.sum(number), F.lit(0))


def mean(number: Column) -> Column:
    return F.coalesce(F.avg(number), F.lit(0.0))


def sample(value: Column) -> Column:
    return F.any_value(value)


def total_term(t: Column) -> Column:
    """SUM as a term: integer, decimal or double, the widest type of the group; 0 for an empty one.

    A value that is no number, or an unbound one, makes the result unbound. Whole numbers and decimals
    are added exactly within 38 digits, beyond them the result is unbound.
    """
    return terms.number_term(*_sums(t))


def mean_term(t: Column) -> Column:
    """AVG as a term: of whole numbers a decimal, exact to 18 places; else as :func:`total_term`.

    Sums of more than 20 digits before the point make it unbound.
    """
    error, width, whole, exact, inexact = _sums(t)
    parts = F.count(F.lit(1))
    shared = F.try_divide(exact, parts.cast("decimal(20,0)")).cast("decimal(38,18)")
    width = F.when(parts == 0, terms.INTEGER).otherwise(F.greatest(width, F.lit(terms.DECIMAL)))
    return terms.number_term(error, width, whole, shared, inexact / parts)


def _sums(t: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Whether some value is no number, the widest numeric type, and the sum as each of these types.

    A group of whole numbers keeps all its 38 digits; beside decimals it has 20 before the point.
    """
    width = terms.numeric_width(t)
    error = F.coalesce(F.max(width.isNull().cast("int")), F.lit(0)) == 1
    wide = F.coalesce(F.max(width), F.lit(terms.INTEGER))
    whole = F.when(width == terms.INTEGER, t["value"].try_cast("decimal(38,0)"))
    exact = F.when(width < terms.DOUBLE, t["value"].try_cast("decimal(38,18)"))
    lost = F.coalesce(F.max(((width < terms.DOUBLE) & exact.isNull()).cast("int")), F.lit(0)) == 1
    zero = F.lit(0).cast("decimal(38,0)")
    whole_sum = F.when(F.count(F.lit(1)) == 0, zero).otherwise(F.try_sum(whole))
    inexact = F.sum(F.when(width.isNotNull(), t["value"].try_cast("double")))
    return error, wide, whole_sum, F.when(~lost, F.try_sum(exact)), inexact


def least_term(t: Column) -> Column:
    """MIN by term order; unbound values are passed over."""
    return F.min(F.when(t.isNotNull(), F.struct(terms.order_key(t).alias("k"), t.alias("t"))))["t"]


def greatest_term(t: Column) -> Column:
    """MAX by term order."""
    return F.max(F.when(t.isNotNull(), F.struct(terms.order_key(t).alias("k"), t.alias("t"))))["t"]


def sample_term(t: Column) -> Column:
    """SAMPLE that does not depend on the order of rows."""
    return F.min(t)


def group_concat(text: Column, separator: str = " ", distinct: bool = False) -> Column:
    """Joined text of a group, in text order. The result is one cell, so groups must fit one."""
    return F.listagg_distinct(text, F.lit(separator)) if distinct else F.listagg(text, F.lit(separator))


# --- wide view -----------------------------------------------------------------------------------


def wide_view(graph: Graph, class_iri: str, fields: dict[str, str], subject: str = "item", nested: dict[str, dict[str, str]] | None = None) -> Solutions:
    """One optional part per chosen field; ``nested`` maps a link field to the fields of its target.

    Several values of a field multiply rows, as optional parts do.
    """
    out = graph.match("?" + subject, fixed.RDF_TYPE, class_iri)
    for name, predicate in fields.items():
        if nested and name in nested:
            block = graph.match("?" + subject, predicate, "?" + name, address=True)
            for inner, inner_predicate in nested[name].items():
                block = block.optional(graph.match("?" + name, inner_predicate, "?" + inner))
            out = out.optional(block)
        else:
            out = out.optional(graph.match("?" + subject, predicate, "?" + name))
    return out
