"""The service: read-only SQL over databases of measurements, ingest and upkeep."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.operators import maintain
from tarnlight.plans import dialect, special, validate
from tarnlight.session import configure
from tarnlight.sources import imports, lineproto, messages, points, tle
from tarnlight.sources.catalog import DATABASE_READ, Catalog, checked

LEVELS = ((1_000_000, "high"), (100_000, "medium"), (10_000, "low"))
_SHOW = re.compile(r"\s*SHOW\s+(DATABASES|TABLES|MEASUREMENTS)(?:\s+(?:FROM|IN)\s+[\"`]?([A-Za-z_][A-Za-z0-9_-]*)[\"`]?)?\s*;?\s*$", re.I)
_EXPLAIN = re.compile(r"\s*EXPLAIN\s+(?:(EXTENDED|FORMATTED|COST|CODEGEN)\s+)?((?:SELECT\b|WITH\b|FROM\b|VALUES\b|\().*)$", re.I | re.S)
_DESCRIBE = re.compile(r"\s*DESC(?:RIBE)?\s+(?:TABLE\s+)?((?:\w+|[\"`][^\"`]+[\"`])(?:\.(?:\w+|[\"`][^\"`]+[\"`]))?)\s*;?\s*$", re.I)
_BOUND = re.compile(r"^\s*time\s*(>=|>|<=|<|=)\s*(?:TIMESTAMP(?:_NTZ)?\s*)?'([^']+)'\s*$", re.I)


class Engine:
    """One catalog and the session that works on it."""

    def __init__(self, spark: SparkSession, root: str, cold: str | None = None, default_database: str = "default"):
        self.spark = configure(spark)
        self.catalog = Catalog(spark, root, cold)
        self.default = default_database

    # queries
    def sql(self, query: str, database: str | None = None, max_rows: int | None = None) -> DataFrame:
        """Run one read-only query.

        ``m`` is a measurement of ``database`` (or the default), ``db.m`` of another; with
        ``database`` given, qualified names are refused.  A measurement without files is
        an empty relation, not an error: of its columns if it ever had files, else of
        those that the query takes from it by name.  Columns that cannot be told so give
        an empty result.
        """
        if m := _SHOW.match(query):
            what, of = m[1].upper(), m[2] or database
            return self.catalog.show_databases() if what == "DATABASES" else self.catalog.show_tables(of)
        if m := _EXPLAIN.match(query):
            plan = self.sql(m[2], database)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(m[1] or "simple"))
            return self.spark.createDataFrame([(plan,)], "plan string")
        if m := _DESCRIBE.match(query):
            fields = self._table([x.strip('"`') for x in m[1].split(".")], database).dtypes
            return self.spark.createDataFrame(fields, "col_name string, data_type string")
        if len(query) > validate.MOST_CHARS:
            raise validate.Rejected(f"query is longer than {validate.MOST_CHARS} characters")
        if by_name := _by_name(query):
            parts = [self.sql(p, database) for p in by_name[0]]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p, allowMissingColumns=True)
            return out if by_name[1] else out.distinct()
        if re.search(r"\b(ASOF|POSITIONAL)\b", query, re.I):
            query = special.rewrite(query, lambda name: self._table(name, database))
        text = dialect.translate(query)
        if (n := self._counted(text, database)) is not None:
            out = self.spark.createDataFrame([(n[1],)], f"`{n[0]}` long")
            return out.limit(max_rows) if max_rows is not None else out
        text, unknown = self._bound(text, validate.parsed(self.spark, text, translated=True), database)
        try:
            out = self.spark.sql(text)
        except AnalysisException as e:
            if not unknown or "UNRESOLVED_COLUMN" not in str(e.getCondition()):
                raise
            # a column of a measurement that never was written: there can be no such rows
            return self.spark.createDataFrame([], "time timestamp").limit(0).drop("time")
        if unknown and out.columns == ["time"] and re.match(r"\s*SELECT\s+\*", text, re.I):
            return out.drop("time")
        return out.limit(max_rows) if max_rows is not None else out

    def _bound(self, text: str, plan, database: str | None) -> tuple[str, bool]:
        """The text with views in the places where Spark's parse has relations of the catalog.

        CTEs are seen where the parse puts them, and words like FROM inside calls are none
        of relations.  A relation that was never written is an empty view of the columns
        that the text takes from it; the flag says that there is one.
        """
        start, end = _time_bounds(dialect.tokens(text))
        unknown, edits = False, []
        for relation, aliased in _relations(plan, frozenset(), False):
            name = validate._items(relation.multipartIdentifier())
            if len(name) == 1 and self.spark.catalog.tableExists(name[0].replace("`", "")):
                continue
            if len(name) == 2 and database is not None:
                raise validate.Rejected("qualified names cannot be used with a database argument")
            db, m = name if len(name) == 2 else (database or self.default, name[0])
            view = self._view(db, m, start, end)
            if view is None:
                unknown, view = True, self._nothing(db, m, text)
            origin = relation.origin()
            edits.append((origin.startIndex().get(), origin.stopIndex().get() + 1, view, None if aliased else m))
        for a, b, view, alias in sorted(edits, reverse=True):
            if alias is not None:  # behind a sample clause, if there is one
                sample = re.match(r"\s*TABLESAMPLE\s*\([^)]*\)(?:\s*REPEATABLE\s*\([^)]*\))?", text[b:], re.I)
                at = b + (sample.end() if sample else 0)
                if not re.search(r"\bTABLE\s*$", text[:a], re.I):
                    text = f"{text[:at]} AS `{alias}`{text[at:]}"
            text = f"{text[:a]}`{view}`{text[b:]}"
        return text, unknown

    def _nothing(self, database: str, measurement: str, text: str) -> str:
        """A view without rows for a measurement that was never written."""
        ts = [t for t in dialect.tokens(text) if t.kind != "space"]
        plain = lambda t: t.text.strip("`")
        names = {measurement.lower()}
        for i, t in enumerate(ts[:-1]):
            if t.kind in ("word", "ident") and plain(t).lower() == measurement.lower():
                nxt = ts[i + 2] if ts[i + 1].upper == "AS" and i + 2 < len(ts) else ts[i + 1]
                if nxt.kind == "ident" or (nxt.kind == "word" and nxt.upper not in _AFTER):
                    names.add(plain(nxt).lower())
        found = {"time"} | {plain(c) for a, dot, c in zip(ts, ts[1:], ts[2:]) if dot.text == "." and plain(a).lower() in names and c.kind in ("word", "ident")}
        view = f"__no__{database}__{measurement}".replace("-", "_m")
        self.spark.createDataFrame([], ", ".join(f"`{c}` {'timestamp' if c == 'time' else 'string'}" for c in sorted(found))).createOrReplaceTempView(view)
        return view

    def _counted(self, text: str, database: str | None) -> tuple[str, int] | None:
        """Name and value of a bare count of all rows of a measurement: the log knows it."""
        m = _COUNT.match(text)
        if not m:
            return None
        name = [x.strip("`") for x in m[2].split(".")]
        if (len(name) == 2 and database is not None) or (len(name) == 1 and self.spark.catalog.tableExists(name[0])):
            return None
        db, asked = name if len(name) == 2 else (database or self.default, name[0])
        checked(db, DATABASE_READ, "database")
        known = {n.lower(): n for n in self.catalog.measurements(db)}
        return (m[1] or "count(1)").strip("`"), self.catalog.row_count(db, known[asked.lower()]) if asked.lower() in known else 0

    def _table(self, name: list[str], database: str | None) -> DataFrame:
        """A measurement, or a view of the session, by its one- or two-part name."""
        if len(name) == 1 and self.spark.catalog.tableExists(name[0]):
            return self.spark.table(name[0])
        if len(name) == 2 and database is not None:
            raise validate.Rejected("qualified names cannot be used with a database argument")
        view = self._view(*(name if len(name) == 2 else (database or self.default, name[0])), None, None)
        if view is None:
            raise validate.Rejected(f"no data in {'.'.join(name)}")
        return self.spark.table(f"`{view}`")

    def _view(self, database: str, measurement: str, start: int | None, end: int | None) -> str | None:
        checked(database, DATABASE_READ, "database")
        known = {n.lower(): n for n in self.catalog.measurements(database)}
        measurement = known.get(measurement.lower(), measurement)
        df = self.catalog.scan(database, measurement, start, end) if measurement in known.values() else None
        if df is None:
            return None
        view = f"{database}__{measurement}__{start or ''}_{end or ''}".replace("-", "_m")
        df.createOrReplaceTempView(view)
        return view

    def measurement(self, database: str, measurement: str, where: str | None = None, order_by: str = "time DESC", limit: int = 100, offset: int = 0) -> DataFrame:
        """Rows of one measurement; ``where`` and ``order_by`` are SQL without set operations."""
        if not 0 <= limit <= 1_000_000:
            raise validate.Rejected("limit must be between 0 and 1,000,000")
        for part in (where or "", order_by):
            if re.search(r"\b(UNION|INTERSECT|EXCEPT)\b|;", part, re.I):
                raise validate.Rejected("set operations are not allowed here")
        text = f'SELECT * FROM "{measurement}"' + (f" WHERE {where}" if where else "") + f" ORDER BY {order_by} LIMIT {limit} OFFSET {offset}"
        return self.sql(text, database)

    def estimate(self, query: str, database: str | None = None) -> dict:
        """Rows that the query would give, and how heavy that is."""
        n = self.sql(query, database).count()
        return {"estimated_rows": n, "warning_level": next((name for least, name in LEVELS if n > least), "none")}

    def count(self, database: str, measurement: str) -> int:
        return self.catalog.row_count(database, measurement)

    def explain(self, query: str, database: str | None = None) -> str:
        return self.sql(query, database)._jdf.queryExecution().toString()

    # ingest
    def write_df(self, df: DataFrame, database: str, measurement: str, tags: list[str] | None = None, **options) -> dict:
        return self.catalog.write(df, database, measurement, tags=tags, **options)

    def _write_points(self, pts: DataFrame, database: str, batch: tuple[str, int] | None = None) -> dict[str, int]:
        pts = pts.persist()
        try:
            out = {}
            for m, df in points.measurements(pts).items():
                known = self.catalog.write(df, database, m, batch=batch)
                out[m] = sum(f["rows"] for f in known["files"].values() if f["commit"] == known["mine"])
            return out
        finally:
            pts.unpersist()

    def write_lines(self, lines: Iterable[str] | DataFrame, database: str | None = None, precision: str = "ns") -> dict[str, int]:
        df = lines if isinstance(lines, DataFrame) else self.spark.createDataFrame([(x,) for text in lines for x in text.splitlines()], "value string")
        return self._write_points(lineproto.parse_lines(df, precision), database or self.default)

    def write_messages(self, payloads: Iterable[bytes] | DataFrame, database: str | None = None, form: str = "msgpack") -> dict[str, int]:
        df = payloads if isinstance(payloads, DataFrame) else self.spark.createDataFrame([(bytearray(x),) for x in payloads], "value binary")
        return self._write_points(messages.decode(df, form=form, bad="fail"), database or self.default)

    def write_tle(self, text: str, database: str | None = None, measurement: str = "satellite_tle") -> dict:
        df = tle.parse_elements(self.spark.createDataFrame([(text,)], "value string"))
        return self.catalog.write(df, database or self.default, measurement, tags=["norad_id", "object_name", "classification", "international_designator", "orbit_type"])

    def import_csv(self, path: str, database: str, measurement: str, **options) -> dict:
        return self._imported(imports.read_csv(self.spark, path, **options), database, measurement)

    def import_parquet(self, path: str, database: str, measurement: str, **options) -> dict:
        return self._imported(imports.read_parquet(self.spark, path, **options), database, measurement)

    def import_lines(self, path: str, database: str, precision: str = "ns") -> dict[str, int]:
        return self._write_points(lineproto.read_lines(self.spark, path, precision=precision), database)

    def import_tle(self, path: str, database: str, measurement: str = "satellite_tle") -> dict:
        return self._imported(tle.read_elements(self.spark, path), database, measurement)

    def _imported(self, df: DataFrame, database: str, measurement: str) -> dict:
        known = self.catalog.write(df, database, measurement)
        return imports.import_report(df.columns, [f for f in known["files"].values() if f["commit"] == known["mine"]])

    # upkeep
    def compaction_candidates(self, database: str, measurement: str, tier: str = "hourly", **options) -> list[dict]:
        return maintain.candidates(self.catalog, database, measurement, tier, **options)

    def compact(self, database: str, measurement: str, tier: str = "hourly", **options) -> list[dict]:
        return maintain.compact_all(self.catalog, database, measurement, self.compaction_candidates(database, measurement, tier, **options), tier)

    def delete_where(self, database: str, measurement: str, predicate: str, **options) -> dict:
        return maintain.delete_where(self.catalog, database, measurement, predicate, **options)

    def retention(self, database: str, days: int, measurement: str | None = None, **options) -> dict[str, dict]:
        """Every measurement of the database unless one is named."""
        return {m: maintain.retention(self.catalog, database, m, days, **options) for m in ([measurement] if measurement else self.catalog.measurements(database))}

    # results
    @staticmethod
    def to_json_rows(df: DataFrame) -> DataFrame:
        """Rows as JSON text: NaN and infinities become null, instants RFC 3339 in UTC."""
        cols = []
        for name, kind in df.dtypes:
            c = F.col(f"`{name}`")
            if kind in ("double", "float"):
                c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
            elif kind == "binary":
                c = c.cast("string")
            elif kind in ("timestamp", "timestamp_ntz"):
                fraction = F.rtrim(F.date_format(c, ".SSSSSS"), F.lit("0"))
                c = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == ".", "").otherwise(fraction), F.lit("Z"))
            cols.append(c.alias(name))
        return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))

    @staticmethod
    def to_arrow(df: DataFrame, dictionary: bool = False, most: int = 4096):
        """An Arrow table; ``dictionary`` encodes text columns with few distinct values."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out = df.toArrow()
        if dictionary:
            for i, f in enumerate(out.schema):
                if pa.types.is_string(f.type) and out.num_rows and pc.count_distinct(out.column(i)).as_py() <= min(most, max(1, out.num_rows // 2)):
                    out = out.set_column(i, f.name, out.column(i).dictionary_encode())
        return out

    @staticmethod
    def to_ipc(df: DataFrame, compression: str | None = None, dictionary: bool = False) -> bytes:
        import pyarrow as pa

        out = Engine.to_arrow(df, dictionary)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as w:
            w.write_table(out)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def to_msgpack(df: DataFrame) -> bytes:
        """Columns, type names and column-wise data as MessagePack."""
        t = df.toArrow()
        data = [[v.isoformat() if hasattr(v, "isoformat") else v if isinstance(v, (int, float, str, bool, bytes, type(None))) else json.dumps(v, default=str) for v in c.to_pylist()] for c in t.columns]
        return messages.pack({"columns": t.schema.names, "types": [str(x) for x in t.schema.types], "data": data, "row_count": t.num_rows})


_COUNT = re.compile(r"^\s*SELECT\s+COUNT\s*\(\s*(?:\*|1)\s*\)(?:\s+(?:AS\s+)?(`[^`]+`|\w+))?\s+FROM\s+((?:`[\w-]+`|\w+)(?:\.(?:`[\w-]+`|\w+))?)\s*$", re.I)
_AFTER = frozenset("WHERE GROUP ORDER HAVING LIMIT OFFSET ON JOIN LEFT RIGHT FULL INNER OUTER CROSS NATURAL SEMI ANTI UNION INTERSECT EXCEPT USING WINDOW LATERAL TABLESAMPLE PIVOT UNPIVOT".split()) | {""}


def _relations(plan, known: frozenset, aliased: bool):
    """(node, has an alias) of every relation below a parsed plan that is no CTE in scope."""
    name = plan.nodeName().split(" ")[0].lstrip("'")
    if name == "UnresolvedRelation":
        parts = validate._items(plan.multipartIdentifier())
        if len(parts) > 1 or parts[0].lower() not in known:
            yield plan, aliased
        return
    if name == "UnresolvedWith":
        for cte in validate._items(plan.innerChildren()):
            own = cte.alias().lower()
            yield from _relations(cte.children().apply(0), known | {own} if plan.allowRecursion() else known, False)
            known = known | {own}
    below = name == "SubqueryAlias" or (aliased and name == "Sample")
    for child in validate._items(plan.children()):
        yield from _relations(child, known, below)
    for sub in validate._items(plan.subqueries()):
        yield from _relations(sub, known, False)


def _time_bounds(ts) -> tuple[int | None, int | None]:
    """Bounds on ``time`` that hold for every relation of a query with exactly one of them.

    Only top-level conjuncts of the one WHERE clause of a query without joins, set
    operations or subqueries are used; anything else reads all files, which is right too.
    """
    from tarnlight.sources.timeunits import parse_text

    words = [t.upper for t in ts]
    if words.count("FROM") != 1 or words.count("WHERE") != 1 or "JOIN" in words or "OR" in words or "SELECT" not in words or words.count("SELECT") != 1:
        return None, None
    at = words.index("WHERE")
    if dialect._find(ts, "WHERE") is None:
        return None, None
    ends = [i for w in ("GROUP", "ORDER", "HAVING", "LIMIT", "WINDOW", "QUALIFY") if (i := dialect._find(ts, w, at)) is not None]
    clause, parts, depth = ts[at + 1 : min(ends, default=len(ts))], [[]], 0
    if "," in [t.text for t in ts[words.index("FROM") : at]] or "BETWEEN" in [t.upper for t in clause]:
        return None, None
    for t in clause:
        depth += {"(": 1, ")": -1}.get(t.text, 0)
        if t.upper == "AND" and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    start = end = None
    for p in parts:
        m = _BOUND.match(dialect.text_of(p))
        at = parse_text(m[2]) if m else None
        if at is None:
            continue
        if m[1] in (">=", ">", "="):
            start = at if start is None else max(start, at)
        if m[1] in ("<=", "<", "="):
            end = at if end is None else min(end, at)
    return start, end


def _by_name(query: str) -> tuple[list[str], bool] | None:
    """The parts of a top-level UNION [ALL] BY NAME, and whether all rows stay."""
    ts, parts, depth, every, i = dialect.tokens(query), [[]], 0, True, 0
    while i < len(ts):
        depth += {"(": 1, ")": -1}.get(ts[i].text, 0)
        words = [t.upper for t in ts[i : i + 8] if t.kind != "space"][:4]
        if depth == 0 and words[:1] == ["UNION"] and (words[1:3] == ["BY", "NAME"] or words[1:4] == ["ALL", "BY", "NAME"]):
            every = every and words[1] == "ALL"
            while ts[i].upper != "NAME":
                i += 1
            parts.append([])
        else:
            parts[-1].append(ts[i])
        i += 1
    return ([dialect.text_of(p) for p in parts], every) if len(parts) > 1 else None
