"""The SQL dialect with spatial, text and vector clauses, compiled to DataFrames.

`Session.execute` takes one statement; `Session.script` several, separated by semicolons, undoing an
open transaction if one fails. SELECT gives a DataFrame that Catalyst plans like any other: an index
only says which operator answers a clause, never what the answer is.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumenquery.functions import spatial as G, vectors as V
from lumenquery.operators import relational as R, snapshots as N, text_index as X
from lumenquery.session import cut


class SqlError(ValueError):
    """The statement is not of the dialect, or names or types do not fit."""


_LEX = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d*)?)|(?P<str>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<name>[^\W\d]\w*)|(?P<op><>|!=|<=|>=|[=<>(),.*;-]))""")
_WORDS = frozenset(
    "select from where insert into values delete order by group asc desc and or join on begin transaction start commit end rollback abort explain analyze create table primary key using drop "
    "between point polygon limit index update set like in not as match similar_to with".split()
)
_SPATIAL = {"distancia": "haversine", "distancia_geo": "haversine", "distancia_haversine": "haversine", "distancia_euclidiana": "euclidean"}
_TYPES = {"smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType(), "char": T.StringType(), "varchar": T.StringType()}
POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
_INDEXES = {"btree": "ordered", "bplus": "ordered", "hash": "hash", "rtree": "spatial", "inverted": "text", "exact": "vector", "hnsw": "vector", "ivf": "vector"}


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, value) tokens: num, str, word (keyword, lower-case), name, op."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise SqlError(f"position {at}: unexpected {text[at]!r}")
        at = m.end()
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "str":
            value = value[1:-1].replace(value[0] * 2, value[0])
        elif kind == "name" and value.lower() in _WORDS:
            kind, value = "word", value.lower()
        out.append((kind, value))
    return out


@dataclass
class Table:
    df: DataFrame
    key: str
    indexes: dict[str, dict] = field(default_factory=dict)


@dataclass
class Clauses:
    """What a WHERE holds besides a plain predicate."""

    match: tuple | None = None  # column, words, method
    similar: tuple | None = None  # query, k, method, metric


def _kind(data: T.DataType) -> str | None:
    """What a type compares with: numbers, text, points; other types, such as dates, are left to Spark."""
    if isinstance(data, T.NumericType):
        return "a number"
    if isinstance(data, T.StringType):
        return "text"
    return "a POINT" if isinstance(data, T.StructType) else None


def _assigned(field: T.StructField, value):
    """A literal as a column takes it; a value of another kind or too long is an error."""
    kind = "text" if isinstance(value, str) else "a number" if isinstance(value, (int, float)) else "a POINT"
    if _kind(field.dataType) not in (None, kind):
        raise SqlError(f"{field.name} takes {_kind(field.dataType)}, not {kind}")
    size = field.metadata.get("bytes")
    if size and isinstance(value, str) and len(value.encode()) > size:
        raise SqlError(f"{field.name} takes {size} bytes")
    return float(value) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else value


class _Parser:
    """Reads tokens; subclass methods build Columns against a scope of tables."""

    def __init__(self, session: Session, text: str):
        self.s, self.toks, self.at = session, lex(text), 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.toks) and self.toks[self.at][0] in ("word", "op") and self.toks[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, *values: str) -> None:
        for v in values:
            if not self.take(v):
                raise SqlError(f"expected {v!r} at {self.toks[self.at][1]!r}" if self.at < len(self.toks) else f"expected {v!r} at the end")

    def get(self, *kinds: str) -> str:
        if self.at >= len(self.toks) or self.toks[self.at][0] not in kinds:
            raise SqlError(f"expected {' or '.join(kinds)}" + (f" at {self.toks[self.at][1]!r}" if self.at < len(self.toks) else " at the end"))
        self.at += 1
        return self.toks[self.at - 1][1]

    def number(self):
        sign = -1 if self.take("-") else 1
        raw = self.get("num")
        return sign * (float(raw) if "." in raw else int(raw))

    def point(self) -> tuple[float, float]:
        if not self.peek("point"):
            name = self.get("name")
            if name not in self.s.variables:
                raise SqlError(f"no point variable {name}")
            return self.s.variables[name]
        self.need("point", "(")
        lat = float(self.number())
        self.need(",")
        lon = float(self.number())
        self.need(")")
        if abs(lat) > 90 or abs(lon) > 180:
            raise SqlError("a point is out of range")
        return lat, lon

    def polygon(self) -> list[tuple[float, float]]:
        self.need("polygon", "(")
        out = [self.point()]
        while self.take(","):
            out.append(self.point())
        self.need(")")
        if len(out) < 3:
            raise SqlError("a polygon has three vertices or more")
        return out

    def name(self) -> str:
        first = self.get("name")
        return f"{first}.{self.get('name')}" if self.take(".") else first

    def value(self, scope, kind: str | None = None):
        """A literal as a Python value, or a Column of the scope; with a kind, one that compares with it."""
        at = self.at
        if self.peek("-") or self.toks[at][0] == "num":
            self._like_kind(kind, "a number")
            return self.number()
        if self.toks[at][0] == "str":
            self._like_kind(kind, "text")
            return self.get("str")
        if self.toks[at][0] == "name" and not self.peek("point") and hasattr(scope, "kind"):
            name = self.name()
            self._like_kind(kind, scope.kind(name))
            return scope(name)
        if self.peek("point"):
            return F.struct(*[F.lit(x).alias(n) for x, n in zip(self.point(), ("lat", "lon"), strict=True)])
        return scope(self.name())

    @staticmethod
    def _like_kind(left: str | None, right: str | None) -> None:
        if left and right and left != right:
            raise SqlError(f"{left} doesn't compare with {right}")
        if "a POINT" in (left, right):
            raise SqlError("a POINT stands in spatial functions only")

    # ---- expressions

    def spatial_argument(self, scope) -> tuple[Column, Column]:
        if self.peek("point") or (self.toks[self.at][0] == "name" and self.toks[self.at][1] in self.s.variables):
            lat, lon = self.point()
            return F.lit(lat), F.lit(lon)
        c = scope(self.name())
        return c["lat"], c["lon"]

    def function(self, scope) -> tuple[str, Column]:
        """A spatial or score function call: its label and Column."""
        start = self.at
        fn = self.get("name").lower()
        self.need("(")
        if fn in ("score", "similarity_score"):
            self.need(")")
            return f"{fn}()", scope(f"__{fn}")
        a = self.spatial_argument(scope)
        self.need(",")
        if fn == "dentro_de":
            out = G.in_polygon(a[0], a[1], self.polygon())
        elif fn in _SPATIAL:
            out = G.METRICS[_SPATIAL[fn]](*a, *self.spatial_argument(scope))
        else:
            raise SqlError(f"no function {fn}")
        self.need(")")
        return "".join(v for _, v in self.toks[start : self.at]), out

    def is_call(self) -> bool:
        return self.at + 1 < len(self.toks) and self.toks[self.at][0] == "name" and self.toks[self.at + 1] == ("op", "(")

    def condition(self, scope, clauses: Clauses | None) -> Column:
        left = self.conjunction(scope, clauses)
        while self.take("or"):
            left = left | self.conjunction(scope, None)
        return left

    def conjunction(self, scope, clauses) -> Column:
        left = self.negation(scope, clauses)
        while self.take("and"):
            left = left & self.negation(scope, clauses)
        if clauses is not None and self.peek("or") and (clauses.match or clauses.similar):
            raise SqlError("MATCH and SIMILAR_TO stand under AND only")
        return left

    def negation(self, scope, clauses) -> Column:
        if self.take("not"):
            return ~self.negation(scope, None)
        if self.take("("):
            inner = self.condition(scope, clauses)
            self.need(")")
            return inner
        if self.peek("match", "similar_to"):
            return self.search(clauses)
        return self.predicate(scope)

    def search(self, clauses: Clauses | None) -> Column:
        if clauses is None:
            raise SqlError("MATCH and SIMILAR_TO stand under AND in a SELECT only")
        if clauses.match or clauses.similar:
            raise SqlError("one MATCH or SIMILAR_TO a query")
        if self.take("match"):
            self.need("(")
            column = self.name()
            self.need(",")
            words = self.get("str")
            self.need(")", "using")
            method = self.get("name").upper()
            if method not in ("TF_IDF", "BM25"):
                raise SqlError("USING takes TF_IDF or BM25")
            clauses.match = (column, words, method)
        else:
            self.need("similar_to", "(")
            asked = self.get("str")
            self.need(",")
            if self.get("name").lower() != "k":
                raise SqlError("SIMILAR_TO takes k=n")
            self.need("=")
            k = self.number()
            self.need(")", "using")
            method = self.get("name").upper()
            if method not in ("EXACT", "HNSW", "IVF"):
                raise SqlError("USING takes EXACT, HNSW or IVF")
            metric = "cosine"
            if self.take("with"):
                if self.get("name").lower() != "metric":
                    raise SqlError("WITH takes METRIC=...")
                self.need("=")
                metric = self.get("name").lower()
            if metric not in V.DISTANCES or not isinstance(k, int) or k < 1:
                raise SqlError("METRIC is cosine, euclidean or dot, and k a positive integer")
            clauses.similar = (asked, k, method, metric)
        return F.lit(True)

    def predicate(self, scope) -> Column:
        if self.is_call():
            _, left = self.function(scope)
            if not self.peek("=", "!=", "<>", "<", "<=", ">", ">="):
                return left
            kind = "a number"
        else:
            name = self.name()
            left, kind = scope(name), scope.kind(name)
            self._like_kind(kind, None)
        negated = self.take("not")
        if self.take("like"):
            self._like_kind(kind, "text")
            out = R.like(left, self.get("str"))
        elif self.take("between"):
            low = self.value(scope, kind)
            self.need("and")
            out = (left >= low) & (left <= self.value(scope, kind))
        elif self.take("in"):
            self.need("(")
            if self.peek("select"):
                sub = self.select(nested=True)
                if len(sub.columns) != 1:
                    raise SqlError("a subquery has one column")
                self.need(")")
                self._like_kind(kind, _kind(sub.schema[0].dataType))
                return self.s.defer(left, sub, negated)
            values = [self.value(scope, kind)]
            while self.take(","):
                values.append(self.value(scope, kind))
            self.need(")")
            out = left.isin(*values)
        elif negated:
            raise SqlError("NOT goes with LIKE, IN and BETWEEN")
        else:
            op = self.get("op")
            right = self.value(scope, kind)
            try:
                out = {"=": left == right, "!=": left != right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
            except KeyError:
                raise SqlError(f"no comparison {op}") from None
        return ~out if negated else out

    # ---- SELECT

    def select(self, nested: bool = False) -> DataFrame:
        self.need("select")
        head = self.at
        depth = 0
        while self.at < len(self.toks) and not (depth == 0 and self.peek("from")):
            depth += self.peek("(") - self.peek(")")
            self.at += 1
        self.need("from")
        first = self.get("name")
        joined = [first]
        df = self.s.named(first)
        qualified = None
        while self.take("join"):
            if qualified is None:
                qualified = df.select([F.col(f"`{c}`").alias(f"{first}.{c}") for c in df.columns])
            other = self.get("name")
            if other in joined:
                raise SqlError(f"{other} is joined twice")
            joined.append(other)
            right = self.s.named(other)
            right = right.select([F.col(f"`{c}`").alias(f"{other}.{c}") for c in right.columns])
            self.need("on")
            a = self.name()
            self.need("=")
            b = self.name()
            if b in qualified.columns:
                a, b = b, a
            if a not in qualified.columns or b not in right.columns:
                raise SqlError(f"no column {a if a not in qualified.columns else b}")
            self._like_kind(_kind(qualified.schema[a].dataType), _kind(right.schema[b].dataType))
            qualified = qualified.join(right, F.col(f"`{a}`") == F.col(f"`{b}`"))
        df = df if qualified is None else qualified

        def scope(name: str) -> Column:
            if name in df.columns or name in ("__score", "__similarity_score"):
                return F.col(f"`{name}`")
            if qualified is None and name.startswith(f"{first}.") and name.split(".", 1)[1] in df.columns:
                return F.col(f"`{name.split('.', 1)[1]}`")
            raise SqlError(f"no column {name}")

        def kind(name: str) -> str | None:
            plain = name if name in df.columns else name.split(".", 1)[-1]
            return _kind(df.schema[plain].dataType) if plain in df.columns else "a number"

        scope.kind = kind
        clauses = Clauses()
        self.s.pending.append([])
        where = self.condition(scope, clauses) if self.take("where") else None
        deferred = self.s.pending.pop()
        df = self.s.filtered(df, where, deferred)
        base = self.s.tables[first]
        ranked = None
        if clauses.match:
            df, ranked = self.s.matched(df, base, *clauses.match), F.desc("__score")
        if clauses.similar:
            df, ranked = self.s.similar(df, base, *clauses.similar), F.asc("__distance")
        group = order = limit = None
        while self.peek("order", "group"):
            if self.take("order"):
                self.need("by")
                order = self.function(scope)[1] if self.is_call() else self.name()
                order = (order, self.take("desc") or (self.take("asc") and False))
            else:
                self.need("group", "by")
                group = self.name()
        if self.take("limit"):
            limit = self.number()
            if not isinstance(limit, int) or limit < 1:
                raise SqlError("LIMIT takes a positive integer")
        tail, self.at = self.at, head
        out = self.project(df, scope, base, group, order, limit, ranked)
        self.at = tail
        if not nested and self.at < len(self.toks) and not self.take(";"):
            raise SqlError(f"unexpected {self.toks[self.at][1]!r}")
        return out

    def project(self, df, scope, base, group, order, limit, ranked) -> DataFrame:
        columns: list[Column] = []
        labels: list[str] = []
        aggregates: list[tuple[str, str | None]] = []
        shown = [c for c in df.columns if not c.startswith("__")]
        star = plain = False

        def add(label: str, c: Column) -> None:
            n, unique = 1, label
            while unique in labels:
                n += 1
                unique = f"{label}_{n}"
            labels.append(unique)
            columns.append(c.alias(unique))

        while True:
            if self.take("*"):
                star = True
                for c in shown:
                    add(c, F.col(f"`{c}`"))
            elif self.is_call() and self.toks[self.at][1].lower() in ("count", "sum", "avg"):
                fn = self.get("name").lower()
                self.need("(")
                aggregates.append((fn, None if self.take("*") else self.name()))
                self.need(")")
            elif self.is_call():
                label, c = self.function(scope)
                add(self.get("name") if self.take("as") else label, c)
            else:
                name = self.name()
                plain = True
                add(name, scope(name))
            if not self.take(","):
                break
        if star and (plain or aggregates):
            raise SqlError("* goes with functions only")
        if not self.peek("from"):
            raise SqlError(f"unexpected {self.toks[self.at][1]!r}")
        if group:
            scope(group)
            if any(c != group for c in labels):
                raise SqlError("columns beside aggregates are grouped")
            renamed = df.withColumnRenamed(group, "__group") if "." in group else df
            out = R.group_by(renamed, "__group" if "." in group else group, aggregates)
            if "." in group:
                out = out.withColumnRenamed("__group", group)
            if order and order[0] == group:
                out = out.orderBy(F.col(f"`{group}`").desc() if order[1] else F.col(f"`{group}`"))
            return out.limit(limit) if limit else out
        if aggregates:
            if labels:
                raise SqlError("columns beside aggregates are grouped")
            found = dict.fromkeys(aggregates)
            return df.agg(*[R.total(fn, scope(c) if c else None, f"{fn}({c or '*'})") for fn, c in found])
        by = None
        if order:
            key = order[0] if isinstance(order[0], Column) else None
            if key is None:
                key = next((c for c, label in zip(columns, labels, strict=True) if label == order[0]), None)
                key = scope(order[0]) if key is None else key
            by = key.desc() if order[1] else key.asc()
        elif ranked is not None:
            by = ranked
        if by is not None:
            tie = base.key if base.key in df.columns else shown[0]
            df = df.orderBy(by, F.col(f"`{tie}`"))
        if limit:
            df = df.limit(limit)
        return df.select(columns)


class Session:
    """Tables, variables and transactions of one user of the dialect."""

    def __init__(self, spark: SparkSession, language: str | None = "spanish", stemming: bool = True):
        self.spark, self.language, self.stemming = spark, language, stemming
        self.tables: dict[str, Table] = {}
        self.variables: dict[str, tuple[float, float]] = {}
        self.extractors: dict[tuple[str, str], object] = {}
        self.pending: list[list] = []
        self.saved: dict[str, Table] | None = None

    def register(self, name: str, df: DataFrame, key: str) -> None:
        self.tables[name] = Table(df, key)

    def named(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise SqlError(f"no table {name}")
        return self.tables[name].df

    # ---- planning helpers

    def defer(self, left: Column, sub: DataFrame, negated: bool) -> Column:
        """IN over a subquery becomes a marker column that a join fills in."""
        mark = f"__in{len(self.pending)}_{len(self.pending[-1])}"
        self.pending[-1].append((mark, left, sub.distinct()))
        hit = F.coalesce(F.col(mark), F.lit(False))
        return ~hit if negated else hit

    def filtered(self, df: DataFrame, where: Column | None, deferred: list) -> DataFrame:
        columns = df.columns
        for mark, left, sub in deferred:
            keys = sub.toDF("__k").where("__k IS NOT NULL").withColumn(mark, F.lit(True))
            df = df.withColumn("__left", left).join(keys, F.col("__left") == F.col("__k"), "left").drop("__left", "__k")
        if where is not None:
            df = df.where(where)
        return df.select([F.col(f"`{c}`") for c in columns]) if deferred else df

    def matched(self, df: DataFrame, base: Table, column: str, words: str, method: str) -> DataFrame:
        """Rows that match, with __score; statistics are the whole table's, the filter only drops rows."""
        column = column.split(".")[-1]
        if base.indexes.get(column, {}).get("kind") != "text":
            raise SqlError(f"MATCH needs an inverted index on {column}")
        asked = X.query_terms(self.spark, {"q": words}, self.language, self.stemming)
        kept = base.indexes[column]
        if "postings" not in kept:  # built once for each version of the table
            kept["postings"] = X.TextIndex.of(base.df, base.key, column, self.language, self.stemming)
        hits = kept["postings"].bm25(asked) if method == "BM25" else kept["postings"].tfidf(asked)
        return df.join(hits.select(F.col("id").alias("__id"), F.col("score").alias("__score")), F.col(f"`{base.key}`") == F.col("__id")).drop("__id")

    def similar(self, df: DataFrame, base: Table, asked: str, k: int, method: str, metric: str) -> DataFrame:
        """The k rows nearest among those that pass the filter. HNSW is answered exactly."""
        column = next((c for c, i in base.indexes.items() if i["kind"] == "vector"), None)
        if column is None:
            raise SqlError("SIMILAR_TO needs a vector index")
        fn = self.extractors.get((id(base), column)) or base.indexes[column].get("extractor")
        vector = fn(asked) if fn else json.loads(asked)
        rows = df.withColumn("__vector", base.indexes[column]["column"](F.col(f"`{column}`")) if fn else F.col(f"`{column}`"))
        if method == "IVF" and not fn:
            from lumenquery.operators.vector_search import Ivf

            index = base.indexes[column].setdefault("ivf", None) or Ivf(base.df, base.key, column)
            base.indexes[column]["ivf"] = index
            near = index.cells_near(vector, 8).select(F.col(base.key).alias("__id"))
            rows = rows.join(near, F.col(f"`{base.key}`") == F.col("__id"), "left_semi")
        rows = rows.withColumn("__distance", V.DISTANCES[metric](F.col("__vector"), V.literal(vector))).drop("__vector")
        near = rows.orderBy("__distance", F.col(f"`{base.key}`")).limit(k)
        return near.withColumn("__similarity_score", V.score(metric, F.col("__distance")))

    # ---- statements

    def execute(self, text: str) -> DataFrame | None:
        p = _Parser(self, text)
        if p.peek("select"):
            return p.select()
        if p.take("explain"):
            analyse = p.take("analyze")
            rest = text[re.search(r"(?i)explain(\s+analyze)?", text).end() :]
            return self._explain(rest, analyse)
        for word in ("begin", "start", "commit", "end", "rollback", "abort", "set", "insert", "update", "delete", "create", "drop"):
            if p.take(word):
                return getattr(self, {"start": "_begin", "end": "_commit", "abort": "_rollback"}.get(word, f"_{word}"))(p)
        raise SqlError("no statement of the dialect")

    def script(self, text: str) -> list[DataFrame | None]:
        out = []
        for part in _statements(text):
            try:
                out.append(self.execute(part))
            except Exception:
                if self.saved is not None:
                    self._rollback(None)
                raise
        return out

    def _explain(self, text: str, analyse: bool) -> DataFrame:
        saved = {k: Table(t.df, t.key, dict(t.indexes)) for k, t in self.tables.items()}
        try:
            df = self.execute(text)
            if df is None:
                m = re.search(r"(?i)(?:into|update|from)\s+(\w+)", text)
                df = self.tables[m.group(1)].df
            plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            lines = plan.splitlines() + ([f"rows: {df.count()}"] if analyse else [])
        finally:
            self.tables = saved
        return self.spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "line int, plan string")

    def _begin(self, p) -> None:
        if self.saved is not None:
            raise SqlError("a transaction is open")
        self.saved = {k: Table(t.df, t.key, dict(t.indexes)) for k, t in self.tables.items()}

    def _commit(self, p) -> None:
        if self.saved is None:
            raise SqlError("no transaction is open")
        self.saved = None

    def _rollback(self, p) -> None:
        if self.saved is None:
            raise SqlError("no transaction is open")
        self.tables, self.saved = self.saved, None

    def _set(self, p) -> None:
        name = p.get("name")
        p.need("=")
        self.variables[name] = p.point()

    def _replace(self, name: str, df: DataFrame) -> None:
        """The table's next version; indexes built over the last one are dropped with it."""
        t = self.tables[name]
        for i in t.indexes.values():
            i.pop("ivf", None)
            i.pop("postings", None)
        t.df = cut(df)

    def _insert(self, p) -> None:
        p.need("into")
        name = p.get("name")
        df = self.named(name)
        p.need("values", "(")
        values = []
        while True:
            values.append(p.point() if p.peek("point") else p.value(lambda n: (_ for _ in ()).throw(SqlError(f"{n} is no literal"))))
            if not p.take(","):
                break
        p.need(")")
        if len(values) != len(df.columns):
            raise SqlError("as many values as columns")
        row = []
        for f, v in zip(df.schema.fields, values, strict=True):
            row.append(_assigned(f, v))
        self._replace(name, N.insert(df, [tuple(row)], self.tables[name].key))

    def _update(self, p) -> None:
        name = p.get("name")
        df = self.named(name)
        p.need("set")
        values = {}
        while True:
            column = p.get("name")
            p.need("=")
            values[column] = p.value(lambda n: (_ for _ in ()).throw(SqlError(f"{n} is no literal")))
            if column not in df.columns:
                raise SqlError(f"no column {column}")
            values[column] = _assigned(df.schema[column], values[column])
            if not p.take(","):
                break
        where, deferred = self._where(p, df)
        if deferred:
            raise SqlError("UPDATE takes no subquery")
        self._replace(name, N.update(df, values, where, self.tables[name].key))

    def _delete(self, p) -> None:
        p.need("from")
        name = p.get("name")
        df = self.named(name)
        where, deferred = self._where(p, df)
        if deferred:
            raise SqlError("DELETE takes no subquery")
        self._replace(name, N.delete(df, where))

    def _where(self, p, df: DataFrame):
        def scope(name: str) -> Column:
            if name.split(".")[-1] not in df.columns:
                raise SqlError(f"no column {name}")
            return F.col(f"`{name.split('.')[-1]}`")

        scope.kind = lambda name: _kind(df.schema[name.split(".")[-1]].dataType)
        self.pending.append([])
        where = p.condition(scope, None) if p.take("where") else None
        return where, self.pending.pop()

    def _create(self, p) -> None:
        if self.saved is not None:
            raise SqlError("no CREATE inside a transaction")
        if p.take("table"):
            name = p.get("name")
            if name in self.tables:
                raise SqlError(f"{name} exists")
            p.need("(")
            fields, keys = [], []
            while True:
                column = p.get("name")
                if p.take("point"):
                    kind, size = POINT, None
                else:
                    word = p.get("name").lower()
                    if word not in _TYPES:
                        raise SqlError(f"no type {word}")
                    kind, size = _TYPES[word], None
                    if p.take("("):
                        size = p.number()
                        p.need(")")
                    if word in ("char", "varchar") and not size:
                        raise SqlError(f"{column} needs a size")
                if p.take("primary"):
                    p.need("key")
                    keys.append(column)
                fields.append(T.StructField(column, kind, False, {"bytes": size} if size else {}))
                if not p.take(","):
                    break
            p.need(")")
            if len(keys) != 1:
                raise SqlError("a table has one primary key")
            if p.take("using"):
                p.get("name")
            self.tables[name] = Table(self.spark.createDataFrame([], T.StructType(fields)), keys[0])
            return
        p.need("index")
        if not p.peek("on"):
            p.get("name")
        p.need("on")
        name = p.get("name")
        df = self.named(name)
        p.need("(")
        column = p.get("name")
        p.need(")")
        kind = p.get("name").lower() if p.take("using") else "btree"
        if kind not in _INDEXES or column not in df.columns:
            raise SqlError(f"no index {kind} on {column}")
        if column in self.tables[name].indexes:
            raise SqlError(f"{column} has an index")
        self.tables[name].indexes[column] = {"kind": _INDEXES[kind], "method": kind}

    def use_extractor(self, table: str, column: str, fn, returns: str = "array<double>") -> None:
        """Vectors of a column come from a function of its values, for SIMILAR_TO."""
        from lumenquery.sources.ingest import extractor

        self.tables[table].indexes[column] |= {"extractor": fn, "column": extractor(fn, returns)}

    def _drop(self, p) -> None:
        if self.saved is not None:
            raise SqlError("no DROP inside a transaction")
        p.need("table")
        name = p.get("name")
        self.named(name)
        del self.tables[name]


def _statements(text: str) -> list[str]:
    """Statements between semicolons that stand outside strings."""
    parts, quote, start = [], "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch == ";":
            parts.append(text[start:i])
            start = i + 1
    return [x for x in [*parts, text[start:]] if x.strip()]
