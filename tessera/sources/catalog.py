"""A database of named tables: statements in, DataFrames out.

A table is an immutable DataFrame with a hidden ``rowid``; a statement that changes it makes a new
version, so a transaction's snapshot is a copy of references. Rows that a statement adds, changes or
deletes are stored when it runs (their values may come from random numbers or from the table itself),
as Parquet; rows that it does not touch stay where they are and are read without the others. After
``COMPACT_AFTER`` changes the whole version is stored, which keeps plans short. ``close`` deletes all.
"""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compat
from ..operators.relops import with_rowid
from .formatting import cell
from .sql_text import DialectError, Node, Parser, Token, statements, tokens
from .translate import INT, REAL, TEXT, Scope, Translator, quoted

COMPACT_AFTER = 16
ROWID, NTH = "rowid", "_nth"  # the latter: a row's place in its statement
_SPARK = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType()}
_sequence = itertools.count()


@dataclass
class Column:
    name: str
    kind: str = "TEXT"
    not_null: bool = False
    default: Node | None = None
    default_text: str | None = None
    primary: bool = False
    unique: bool = False
    check: Node | None = None


@dataclass
class Table:
    name: str
    columns: list[Column]
    df: DataFrame
    next_id: int = 1
    changes: int = 0
    sql: str = ""
    #: Columns that are unique together, by the name of the constraint or index.
    uniques: dict[str, list[str]] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary]

    def keys(self) -> list[list[str]]:
        """All sets of columns that no two rows may share."""
        return [self.key()] * bool(self.key()) + [[c.name] for c in self.columns if c.unique and not c.primary] + list(self.uniques.values())

    def own(self, name: str) -> str:
        found = next((c.name for c in self.columns if c.name.lower() == name.lower()), None)
        if found is None:
            raise DialectError(f"no such column: {name}")
        return found


@dataclass
class _State:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, tuple[str, dict, str]] = field(default_factory=dict)


class Database:
    """Runs statements of the dialect over registered tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        compat.register(spark)
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        self.folder, self.kept = f"{root.rstrip('/')}/tessera-db-{uuid.uuid4().hex[:12]}", itertools.count()
        self.state, self.saved = _State(), None
        self.counters = {"changes": 0, "total_changes": 0, "last_insert_rowid": 0}
        self.prefix = f"_t{next(_sequence)}_"

    def close(self) -> None:
        """Delete what the database has stored; frames that read it are of no use after that."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _kept(self, df: DataFrame) -> DataFrame:
        """``df`` computed once, as Parquet in the database's folder."""
        path = f"{self.folder}/{next(self.kept)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # registry
    def attach(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """Register a DataFrame as a table; its rows get no rowid until a statement needs one."""
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}
        columns = [Column(c, kinds.get(t, "TEXT"), primary=c == key) for c, t in df.dtypes]
        self.state.tables[name.lower()] = Table(name, columns, df, sql=f"CREATE TABLE {name}({', '.join(f'{c.name} {c.kind}' for c in columns)})")

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.state.tables.values())

    def schema(self) -> list[str]:
        return [t.sql for _, t in sorted(self.state.tables.items())] + [v[2] for _, v in sorted(self.state.views.items())]

    def _table(self, name: str) -> Table:
        found = self.state.tables.get(name.lower())
        if not found:
            raise DialectError(f"no such table: {name}")
        return found

    def _numbered(self, t: Table) -> Table:
        """The table with its hidden rowid."""
        if ROWID in t.df.columns:
            return t
        key = t.key()
        whole = key and t.columns[[c.name for c in t.columns].index(key[0])].kind == "INTEGER" and len(key) == 1
        df = t.df.withColumn(ROWID, F.col(key[0]).cast("long")) if whole else with_rowid(t.df.withColumn("_o", F.monotonically_increasing_id()), "_o").drop("_o")
        top = df.agg(F.max(ROWID)).first()[0] or 0
        return replace(t, df=df, next_id=top + 1)

    def _lookup(self, uses_rowid: bool):
        def lookup(name: str) -> tuple[str, dict[str, str]]:
            low = name.lower()
            if low in ("sqlite_master", "sqlite_schema"):
                view = self.prefix + "schema"
                self._schema_frame().createOrReplaceTempView(view)
                return view, {"type": TEXT, "name": TEXT, "tbl_name": TEXT, "rootpage": INT, "sql": TEXT}
            if low in self.state.views:
                text, shape, _ = self.state.views[low]
                return f"({text})", shape
            t = self._table(name)
            if uses_rowid:
                t = self.state.tables[low] = self._numbered(t)
            view = self.prefix + low
            kinds = {c.name: {"INTEGER": INT, "REAL": REAL}.get(c.kind, TEXT) for c in t.columns}
            df = t.df.select(*t.names(), ROWID) if uses_rowid else t.df.select(*t.names())
            df.createOrReplaceTempView(view)
            return quoted(view), kinds | ({ROWID: INT} if uses_rowid else {})

        return lookup

    def _schema_frame(self) -> DataFrame:
        rows = [("table", t.name, t.name, 0, t.sql) for t in self.state.tables.values()] + [("view", k, k, 0, v[2]) for k, v in self.state.views.items()]
        return self.spark.createDataFrame(sorted(rows), "type string, name string, tbl_name string, rootpage bigint, sql string")

    # statements
    def execute(self, sql: str) -> DataFrame | None:
        """Run one statement; a DataFrame for what returns rows, else None."""
        found = statements(sql)
        if len(found) != 1:
            raise DialectError("execute takes one statement; use run_script for several")
        return self._run(found[0])

    def run_script(self, script: str) -> list[DataFrame | None]:
        """Run the statements of a script, in order."""
        return [self._run(s) for s in statements(script)]

    def command(self, line: str) -> list[str] | None:
        """A shell line: .tables or .schema [table] list the catalogue, .quit and .exit give None."""
        word, *rest = line.split()
        if word == ".tables":
            return sorted([*self.tables(), *self.state.views])
        if word == ".schema":
            return [self._table(rest[0]).sql] if rest else self.schema()
        if word in (".quit", ".exit"):
            return None
        raise DialectError(f"no such command: {word}")

    def _run(self, found: list[Token]) -> DataFrame | None:
        p = Parser(found)
        self.uses_rowid = any(t.key == "ROWID" for t in found)
        self.text = " ".join("'" + t.text.replace("'", "''") + "'" if t.kind == "text" else t.text for t in found)
        if p.peek("SELECT", "VALUES"):
            return self._select(p)
        if p.peek("WITH"):
            return self._with(p)
        for words, run in (
            (("CREATE", "TABLE"), self._create_table), (("CREATE", "VIEW"), self._create_view), (("CREATE",), self._create_index),
            (("DROP",), self._drop), (("ALTER", "TABLE"), self._alter), (("INSERT",), self._insert), (("REPLACE",), self._replace),
            (("UPDATE",), self._update), (("DELETE", "FROM"), self._delete), (("PRAGMA",), self._pragma),
            (("BEGIN",), self._begin), (("COMMIT",), self._commit), (("ROLLBACK",), self._rollback),
        ):
            if p.take(*words):
                out = run(p)
                if words[0] in ("BEGIN", "COMMIT", "ROLLBACK"):
                    p.take("TRANSACTION")
                p.done()
                return out
        raise DialectError(f"unknown statement near {p.near()}")

    def _translator(self) -> Translator:
        return Translator(self._lookup(self.uses_rowid), self.counters)

    def _select(self, p: Parser) -> DataFrame:
        q = p.query()
        p.done()
        return self.spark.sql(self._translator().query(q, None))

    def _with(self, p: Parser) -> DataFrame | None:
        at = p.at
        depth, main = 0, None
        for i in range(at, len(p.tokens)):
            key = p.tokens[i].key
            depth += (key == "(") - (key == ")")
            if depth == 0 and key in ("INSERT", "UPDATE", "DELETE", "REPLACE"):
                main = i
                break
        if main is None:
            return self._select(p)
        # views of the statement's own stand for its common table expressions
        head = Parser([*p.tokens[at:main], *tokens("SELECT 1")])
        q = head.query()
        before = dict(self.state.views)
        try:
            for i, (name, columns, _) in enumerate(q["ctes"]):
                one = {**q, "cores": [{"distinct": False, "items": [(Node("star"), None)], "from": [("", (name, None), None)], "where": None, "group": [], "having": None}], "ctes": q["ctes"][: i + 1]}
                t = self._translator()
                text, shape = t.query(one, None), t.shape(one, None)
                self.state.views[name.lower()] = (text, shape, "")
            return self._run(p.tokens[main:])
        finally:
            self.state.views = before

    # definitions
    def _exists(self, p: Parser, *words: str) -> bool:
        return p.take("IF", *words)

    def _create_table(self, p: Parser) -> None:
        quiet = self._exists(p, "NOT", "EXISTS")
        name = p.name()
        if name.lower() in self.state.tables:
            if quiet:
                p.at = len(p.tokens)
                return
            raise DialectError(f"table {name} already exists")
        if p.take("AS"):
            q = p.query()
            t = self._translator()
            shape, df = t.shape(q, None), self._kept(self.spark.sql(t.query(q, None)))
            kinds = {INT: "INTEGER", REAL: "REAL"}
            columns = [Column(c, kinds.get(k, "TEXT")) for c, k in zip(df.columns, shape.values(), strict=True)]
            self.state.tables[name.lower()] = Table(name, columns, df, sql=self.text)
            return
        p.need("(")
        columns: list[Column] = []
        uniques: dict[str, list[str]] = {}
        while True:
            if p.peek("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
                self._table_constraint(p, columns, uniques)
            else:
                columns.append(self._column(p))
            if not p.take(","):
                break
        p.need(")")
        schema = T.StructType([T.StructField(c.name, _SPARK[c.kind]) for c in columns] + [T.StructField(ROWID, T.LongType())])
        self.state.tables[name.lower()] = Table(name, columns, self.spark.createDataFrame([], schema), sql=self.text, uniques=uniques)

    def _table_constraint(self, p: Parser, columns: list[Column], uniques: dict[str, list[str]]) -> None:
        if p.take("CONSTRAINT"):
            p.name()
        if p.take("PRIMARY", "KEY"):
            for c in p.names():
                next(x for x in columns if x.name.lower() == c.lower()).primary = True
        elif p.take("UNIQUE"):
            names = p.names()
            found = [next(x for x in columns if x.name.lower() == n.lower()) for n in names]
            if len(found) == 1:
                found[0].unique = True
            else:
                uniques[f"({len(uniques)})"] = [x.name for x in found]
        elif p.take("CHECK", "("):
            check = p.expr()
            p.need(")")
            last = columns[-1]
            last.check = check if last.check is None else Node("and", args=[last.check, check])
        else:
            p.need("FOREIGN", "KEY")
            p.names()
            self._references(p)

    def _references(self, p: Parser) -> None:
        p.need("REFERENCES")
        p.name()
        if p.peek("("):
            p.names()
        while p.take("ON"):
            p.at += 1
            p.take("NULL") or p.take("DEFAULT") or p.take("ACTION") or p.name()

    def _column(self, p: Parser) -> Column:
        out = Column(p.name())
        ends = ("PRIMARY", "NOT", "NULL", "DEFAULT", "UNIQUE", "CHECK", "REFERENCES", "AUTOINCREMENT", "CONSTRAINT")
        if not p.peek(",", ")", *ends) and p.at < len(p.tokens):
            out.kind = p.declared()
        while True:
            if p.take("PRIMARY", "KEY"):
                out.primary = True
                p.take("ASC") or p.take("DESC")
            elif p.take("NOT", "NULL"):
                out.not_null = True
            elif p.take("NULL") or p.take("AUTOINCREMENT"):
                pass
            elif p.take("UNIQUE"):
                out.unique = True
            elif p.take("DEFAULT"):
                start = p.at
                out.default = p.unary()
                out.default_text = " ".join(f"'{t.text}'" if t.kind == "text" else t.text for t in p.tokens[start : p.at])
            elif p.take("CHECK", "("):
                out.check = p.expr()
                p.need(")")
            elif p.peek("REFERENCES"):
                self._references(p)
            else:
                return out

    def _create_view(self, p: Parser) -> None:
        quiet = self._exists(p, "NOT", "EXISTS")
        name = p.name()
        p.need("AS")
        if name.lower() in self.state.views:
            if quiet:
                p.at = len(p.tokens)
                return
            raise DialectError(f"view {name} already exists")
        q = p.query()
        self.state.views[name.lower()] = (_Lazy(self, q), _LazyShape(self, q), self.text)

    def _create_index(self, p: Parser) -> None:
        unique = p.take("UNIQUE")
        p.need("INDEX")
        self._exists(p, "NOT", "EXISTS")
        index = p.name().lower()
        p.need("ON")
        t = self._table(p.name())
        p.need("(")
        listed = p.listed(p.ordering)
        p.need(")")
        columns = [x[0].value[1] for x in listed if x[0].kind == "column"]
        if unique and len(columns) == len(listed):
            key = [t.own(c) for c in columns]
            self._no_repeats(t, t.df, key)
            self.state.tables[t.name.lower()] = replace(t, uniques={**t.uniques, index: key})

    def _drop(self, p: Parser) -> None:
        kind = p.name().upper()
        quiet = self._exists(p, "EXISTS")
        name = p.name()
        where = {"TABLE": self.state.tables, "VIEW": self.state.views}.get(kind, {})
        if kind == "INDEX":
            for low, t in self.state.tables.items():
                self.state.tables[low] = replace(t, uniques={k: v for k, v in t.uniques.items() if k != name.lower()})
        if kind != "INDEX" and where.pop(name.lower(), None) is None and not quiet:
            raise DialectError(f"no such {kind.lower()}: {name}")

    def _alter(self, p: Parser) -> None:
        t = self._table(p.name())
        if p.take("RENAME", "TO"):
            new = p.name()
            del self.state.tables[t.name.lower()]
            self.state.tables[new.lower()] = replace(t, name=new)
            return
        p.need("ADD")
        p.take("COLUMN")
        c = self._column(p)
        value = F.lit(None) if c.default is None else F.expr(self._translator().value(c.default, Scope()))
        self._store(replace(t, columns=[*t.columns, c], df=t.df.withColumn(c.name, value.cast(_SPARK[c.kind]))), 0)

    # changes
    def _store(self, t: Table, changed: int, inserted: bool = False) -> None:
        t = replace(t, changes=t.changes + 1)
        if t.changes % COMPACT_AFTER == 0:
            t = replace(t, df=self._kept(t.df))
        self.state.tables[t.name.lower()] = t
        if inserted:
            self.counters["last_insert_rowid"] = t.next_id - 1
        self.counters["changes"] = changed
        self.counters["total_changes"] += changed

    def _replace(self, p: Parser) -> DataFrame | None:
        return self._insert(p, "REPLACE")

    def _insert(self, p: Parser, policy: str = "") -> DataFrame | None:
        if not policy and p.take("OR"):
            policy = p.name().upper()
        p.need("INTO")
        t = self._numbered(self._table(p.name()))
        names = t.names()
        given = p.names() if p.peek("(") else names
        given = [t.own(g) for g in given]
        new = self._incoming(p, t, given)
        target, sets = None, None
        if p.take("ON", "CONFLICT"):
            target = p.names() if p.peek("(") else (t.key() or [c.name for c in t.columns if c.unique][:1])
            p.need("DO")
            if p.take("NOTHING"):
                policy = "IGNORE"
            else:
                p.need("UPDATE", "SET")
                sets = p.listed(lambda: self._assignment(p))
                policy = "UPDATE"
        shown = self._returning(p)
        new = self._placed(new, t)
        keys = [[t.own(k) for k in target]] if target else t.keys()
        old = t.df
        if policy == "IGNORE":
            for key in keys:
                new = new.join(old.select(*key).dropna().distinct(), key, "left_anti").select(*names, ROWID, NTH)
            new = self._kept(self._accepted(self._kept(new), keys))
        elif policy == "REPLACE":
            # a row replaces whatever shares a key with it, stored or earlier in the statement
            new = self._kept(new)
            for key in keys:
                old = old.join(new.select(*key).dropna().distinct(), key, "left_anti").select(*names, ROWID)
            new = self._kept(self._ranked(new, keys, last=True).filter("_first").drop("_first"))
        elif policy == "UPDATE":
            return self._upsert(t, new, keys[0], sets, shown)
        else:
            new = self._kept(new)
            self._no_conflict(t, new, keys)
        self._check(t, new)
        n, top = new.agg(F.count(F.lit(1)), F.max(ROWID)).first()
        self._store(replace(t, df=old.select(*names, ROWID).unionByName(new.select(*names, ROWID)), next_id=max(t.next_id, (top or 0) + 1)), n, inserted=bool(n))
        return self._show(new, t, shown)

    def _incoming(self, p: Parser, t: Table, given: list[str]) -> DataFrame:
        """The statement's rows with all columns of the table and their order."""
        tr = self._translator()
        empty = Scope()
        default = {c.name: f"CAST({tr.value(c.default, empty) if c.default else 'NULL'} AS {_SPARK[c.kind].simpleString()})" for c in t.columns}
        kinds = {c.name: c.kind for c in t.columns}

        def cast(node: Node, name: str) -> str:
            kind = tr.kind(node, empty)
            if kinds[name] == "TEXT":
                return tr.text(node, empty)
            text = tr.value(node, empty)
            return f"{'try_cast' if kind == TEXT else 'CAST'}({text} AS {_SPARK[kinds[name]].simpleString()})"

        if p.take("DEFAULT", "VALUES"):
            return self.spark.sql("SELECT 0L AS _o, " + ", ".join(f"{default[c]} AS {quoted(c)}" for c in t.names()))
        if p.take("VALUES"):
            rows = p.listed(p.row)
            if any(len(r) != len(given) for r in rows):
                raise DialectError(f"table {t.name} takes {len(given)} values here")
            parts = []
            for i, row in enumerate(rows):
                by = {g: cast(x, g) for g, x in zip(given, row, strict=True)}
                parts.append(f"SELECT {i}L AS _o, " + ", ".join(f"{by.get(c, default[c])} AS {quoted(c)}" for c in t.names()))
            return self.spark.sql(" UNION ALL ".join(parts))
        q = p.query()
        found = self.spark.sql(tr.query(q, None))
        if len(found.columns) != len(given):
            raise DialectError(f"table {t.name} takes {len(given)} values here")
        found = found.toDF(*(f"_c{i}" for i in range(len(given)))).withColumn("_o", F.monotonically_increasing_id())
        by = {g: F.expr(f"try_cast(_c{i} AS {_SPARK[kinds[g]].simpleString()})") for i, g in enumerate(given)}
        return found.select("_o", *(by.get(c, F.expr(default[c])).alias(c) for c in t.names()))

    def _placed(self, new: DataFrame, t: Table) -> DataFrame:
        """Number incoming rows; an integer primary key is the rowid, and a null one takes it."""
        new = with_rowid(self._kept(new), "_o", name=NTH).withColumn(ROWID, F.col(NTH) + (t.next_id - 1)).drop("_o")
        key = t.key()
        if len(key) == 1 and next(c for c in t.columns if c.name == key[0]).kind == "INTEGER":
            new = new.withColumn(key[0], F.coalesce(key[0], ROWID)).withColumn(ROWID, F.col(key[0]))
        return new

    @staticmethod
    def _known(key: list[str]) -> str:
        return " AND ".join(f"{quoted(k)} IS NOT NULL" for k in key)

    def _ranked(self, new: DataFrame, keys: list[list[str]], last: bool = False) -> DataFrame:
        """``new`` with ``_first``: whether a row is the statement's first (or last) of each of its keys; null keys are no keys."""
        order = F.col(NTH).desc() if last else F.col(NTH)
        out = new.withColumn("_first", F.lit(True))
        for key in keys:
            # rows without the key are dealt by their own number, so that they do not meet in one task
            window = Window.partitionBy(*key, F.expr(f"if({self._known(key)}, 0L, {NTH})")).orderBy(order)
            out = out.withColumn("_first", F.col("_first") & (F.row_number().over(window) == 1))
        return out

    def _accepted(self, new: DataFrame, keys: list[list[str]]) -> DataFrame:
        """The rows that find none of their keys taken by an earlier accepted row."""
        ranked = self._ranked(new, keys)
        out = ranked.filter("_first").drop("_first")
        if len(keys) < 2:
            return out
        # a row that loses to one which loses itself may stay: it is asked again without the losers
        rest = ranked.filter("NOT _first").drop("_first")
        for key in keys:
            rest = rest.join(out.select(*key).dropna().distinct(), key, "left_anti").select(*new.columns)
        rest = self._kept(rest)
        return out.unionByName(self._accepted(rest, keys)) if rest.limit(1).count() else out

    def _no_repeats(self, t: Table, rows: DataFrame, key: list[str]) -> None:
        if rows.select(*key).dropna().groupBy(*key).count().filter("count > 1").limit(1).count():
            raise DialectError(f"UNIQUE constraint failed: {', '.join(f'{t.name}.{k}' for k in key)}")

    def _no_conflict(self, t: Table, new: DataFrame, keys: list[list[str]]) -> None:
        for key in keys:
            self._no_repeats(t, t.df.select(*key).join(new.select(*key).dropna().distinct(), key, "left_semi").unionByName(new.select(*key)), key)

    def _check(self, t: Table, new: DataFrame) -> None:
        """NOT NULL and CHECK over the incoming rows, in one job; a null check passes."""
        scope = Scope()
        scope.add(t.name, {c.name: {"INTEGER": INT, "REAL": REAL}.get(c.kind, TEXT) for c in t.columns})
        tr, tests = self._translator(), {}
        for c in t.columns:
            if c.not_null:
                tests[f"NOT NULL constraint failed: {t.name}.{c.name}"] = F.col(c.name).isNull()
            if c.check is not None:
                tests[f"CHECK constraint failed: {t.name}.{c.name}"] = ~F.expr(tr.test(c.check, scope))
        if tests:
            found = new.agg(*(F.max(F.coalesce(x, F.lit(False)).cast("int")).alias(f"x{i}") for i, x in enumerate(tests.values()))).first()
            for message, hit in zip(tests, found, strict=True):
                if hit:
                    raise DialectError(message)

    def _assignment(self, p: Parser) -> tuple[str, Node]:
        name = p.name()
        p.need("=")
        return name, p.expr()

    def _upsert(self, t: Table, new: DataFrame, key: list[str], sets: list[tuple[str, Node]], shown) -> DataFrame | None:
        names = t.names()
        kinds = {c.name: {"INTEGER": INT, "REAL": REAL}.get(c.kind, TEXT) for c in t.columns}
        # a key's rows come one after another: the first of a new key is inserted, each other one updates
        window = Window.partitionBy(*key, F.expr(f"if({self._known(key)}, 0L, {NTH})")).orderBy(NTH)
        new = new.withColumn("_turn", F.row_number().over(window)).join(t.df.select(*key).dropna().distinct().withColumn("_held", F.lit(1)), key, "left")
        new = self._kept(new.withColumn("_turn", F.col("_turn") - F.when(F.col("_held").isNull(), 1).otherwise(0)).drop("_held"))
        base = t.df.select(*names, ROWID, F.lit(False).alias("_hit")).unionByName(new.filter("_turn = 0").select(*names, ROWID, F.lit(True).alias("_hit")))
        scope = Scope()
        scope.add(t.name, kinds)
        scope.add("excluded", kinds)
        scope.sources[t.name.lower()][ROWID] = INT
        tr = self._translator()
        match = F.expr(" AND ".join(f"{quoted(t.name)}.{quoted(k)} = excluded.{quoted(k)}" for k in key))
        hit = F.col(f"excluded.{key[0]}").isNotNull()
        values = {t.own(n): tr._as(self._qualified(e, t), kinds[t.own(n)], scope) for n, e in sets}
        n, turns = new.agg(F.count(F.lit(1)), F.max("_turn")).first()
        for turn in range(1, (turns or 0) + 1):
            left, right = base.alias(t.name), new.filter(f"_turn = {turn}").select(*names).alias("excluded")
            base = self._kept(left.join(right, match, "left").select(*(F.when(hit, F.expr(values[c]).cast(_SPARK[col.kind])).otherwise(F.col(f"{t.name}.{c}")).alias(c) if c in values else F.col(f"{t.name}.{c}").alias(c) for c, col in zip(names, t.columns, strict=True)), F.col(f"{t.name}.{ROWID}").alias(ROWID), (F.col(f"{t.name}._hit") | hit).alias("_hit")))
        touched = base.filter("_hit").drop("_hit")
        self._check(t, touched)
        done = base.drop("_hit")
        for other in t.keys():
            if other != key or set(other) & set(values):
                self._no_repeats(t, done, other)
        self._store(replace(t, df=done, next_id=max(t.next_id, (done.agg(F.max(ROWID)).first()[0] or 0) + 1)), n, inserted=True)
        return self._show(touched, t, shown)

    def _qualified(self, n, t: Table):
        """Bare columns of an upsert's values are the stored row's."""
        if isinstance(n, tuple):
            return tuple(self._qualified(x, t) for x in n)
        if not isinstance(n, Node):
            return n
        if n.kind == "column" and n.value[0] is None:
            return Node("column", (t.name, n.value[1]))
        return Node(n.kind, self._qualified(n.value, t) if isinstance(n.value, Node) else n.value, [self._qualified(x, t) for x in n.args], n.extra)

    def _rows(self, t: Table, where: Node | None) -> tuple[DataFrame, Scope]:
        """The table with ``_hit``: whether the condition holds."""
        scope = Scope()
        scope.add(t.name, {c.name: {"INTEGER": INT, "REAL": REAL}.get(c.kind, TEXT) for c in t.columns} | {ROWID: INT})
        view = self.prefix + "target"
        t.df.select(*t.names(), ROWID).createOrReplaceTempView(view)
        test = "TRUE" if where is None else f"coalesce({self._translator().test(where, scope)}, FALSE)"
        return self.spark.sql(f"SELECT *, {test} AS _hit FROM {view} AS {quoted(t.name)}"), scope

    def _update(self, p: Parser) -> DataFrame | None:
        t = self._numbered(self._table(p.name()))
        p.need("SET")
        sets = p.listed(lambda: self._assignment(p))
        where = p.expr() if p.take("WHERE") else None
        shown = self._returning(p)
        marked, scope = self._rows(t, where)
        marked.createOrReplaceTempView(self.prefix + "marked")
        tr = self._translator()
        values = {t.own(n): e for n, e in sets}
        kinds = {c.name: {"INTEGER": INT, "REAL": REAL}.get(c.kind, TEXT) for c in t.columns}
        items = [f"CASE WHEN _hit THEN {'try_cast' if tr.kind(values[c.name], scope) == TEXT and c.kind != 'TEXT' else 'CAST'}({tr.text(values[c.name], scope) if kinds[c.name] == TEXT else tr.value(values[c.name], scope)} AS {_SPARK[c.kind].simpleString()}) ELSE {quoted(c.name)} END AS {quoted(c.name)}" if c.name in values else quoted(c.name) for c in t.columns]
        touched = self._kept(self.spark.sql(f"SELECT {', '.join(items)}, {ROWID} FROM {self.prefix}marked AS {quoted(t.name)} WHERE _hit"))
        self._check(t, touched)
        new = self._without(t, touched).unionByName(touched)
        for key in t.keys():
            if set(key) & set(values):
                self._no_repeats(t, new, key)
        self._store(replace(t, df=new), touched.count())
        return self._show(touched, t, shown)

    def _without(self, t: Table, gone: DataFrame) -> DataFrame:
        """The table's rows but those of ``gone``, which are stored; the others stay where they are."""
        return t.df.select(*t.names(), ROWID).join(gone.select(ROWID), ROWID, "left_anti").select(*t.names(), ROWID)

    def _delete(self, p: Parser) -> DataFrame | None:
        t = self._numbered(self._table(p.name()))
        where = p.expr() if p.take("WHERE") else None
        shown = self._returning(p)
        marked, _ = self._rows(t, where)
        gone = self._kept(marked.filter("_hit").drop("_hit"))
        left = self._without(t, gone) if where is not None else self.spark.createDataFrame([], t.df.select(*t.names(), ROWID).schema)
        self._store(replace(t, df=left), gone.count())
        return self._show(gone, t, shown)

    def _returning(self, p: Parser) -> list | None:
        return p.listed(p.item) if p.take("RETURNING") else None

    def _show(self, rows: DataFrame, t: Table, shown: list | None) -> DataFrame | None:
        if shown is None:
            return None
        scope = Scope()
        scope.add(t.name, {c.name: {"INTEGER": INT, "REAL": REAL}.get(c.kind, TEXT) for c in t.columns} | {ROWID: INT})
        tr = self._translator()
        return rows.orderBy(ROWID).select(*(F.expr(tr.value(node, scope)).alias(name) for name, node in ((n, Node("column", (None, x.value[1])) if x.kind == "column" else x) for n, x in tr._named(shown, scope))))

    # catalogue and transactions
    def _pragma(self, p: Parser) -> DataFrame | None:
        what, argument = p.name().lower(), None
        if p.take("("):
            argument = p.name() if p.tokens[p.at].kind in ("word", "name") else p.tokens[p.at].text
            p.at = len(p.tokens)
        else:
            p.at = len(p.tokens)
        if what == "table_info" and argument:
            t = self.state.tables.get(argument.lower())
            rows = [(i, c.name, c.kind, int(c.not_null), c.default_text, int(c.primary)) for i, c in enumerate(t.columns)] if t else []
            return self.spark.createDataFrame(rows, "cid bigint, name string, type string, `notnull` bigint, dflt_value string, pk bigint")
        if what == "table_list":
            rows = [("main", n, "table") for n in self.tables()] + [("main", v, "view") for v in sorted(self.state.views)]
            return self.spark.createDataFrame(rows, "schema string, name string, type string")
        return None

    def _begin(self, p: Parser) -> None:
        if self.saved is not None:
            raise DialectError("cannot start a transaction within a transaction")
        self.saved = _State(dict(self.state.tables), dict(self.state.views))

    def _commit(self, p: Parser) -> None:
        if self.saved is None:
            raise DialectError("no transaction is active")
        self.saved = None

    def _rollback(self, p: Parser) -> None:
        if self.saved is None:
            raise DialectError("no transaction is active")
        self.state, self.saved = self.saved, None


class _Lazy:
    """A view's text, translated at each use so that it follows its tables."""

    def __init__(self, db: Database, q: dict):
        self.db, self.q = db, q

    def __str__(self) -> str:
        return Translator(self.db._lookup(False), self.db.counters).query(self.q, None)

    def __format__(self, spec: str) -> str:
        return str(self)


class _LazyShape(dict):
    def __init__(self, db: Database, q: dict):
        super().__init__(Translator(db._lookup(False), db.counters).shape(q, None))


def render(df: DataFrame | None) -> str:
    """Rows as text for tests and shells: columns between bars, nothing for null; OK for no rows to show."""
    if df is None:
        return "OK"
    return "\n".join("|".join(cell(v) for v in row) for row in df.collect())
