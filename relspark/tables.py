"""Tables as sets of immutable Parquet folders: read, append, copy-on-write update and delete.

A change never touches a folder that exists. Inserts add one. Updates and deletes find the folders
that hold matching rows and rewrite only those, so the cost follows what is touched, not the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark import constraints as C
from relspark.catalog import CatalogProblem, Transaction
from relspark.plans.statements import ColumnDef, ConstraintDef
from relspark.types import ColumnType, parse_type

HIT = "__hit"
#: Folders of a table from which on inserts merge the smaller ones.
MOST_PARTS = 64


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def new_table(columns: list[ColumnDef], constraints: list[ConstraintDef]) -> dict[str, Any]:
    """The catalog entry of an empty table; column flags become constraints of the table."""
    names = [c.name for c in columns]
    if len({n.lower() for n in names}) < len(names):
        raise CatalogProblem("two columns have the same name")
    rules = list(constraints)
    if keyed := [c.name for c in columns if c.primary_key]:
        if any(r.kind == "primary" for r in rules):
            raise CatalogProblem("a table has one primary key")
        rules.insert(0, ConstraintDef("primary", keyed))
    if sum(r.kind == "primary" for r in rules) > 1:
        raise CatalogProblem("a table has one primary key")
    rules += [ConstraintDef("unique", [c.name]) for c in columns if c.unique]
    for r in rules:
        for c in r.columns:
            if c not in names:
                raise CatalogProblem(f"no column {c} for the {r.kind} constraint")
    fields = []
    for c in columns:
        never_null = not c.nullable or any(r.kind == "primary" and c.name in r.columns for r in rules)
        fields.append({"name": c.name, "type": str(c.type), "nullable": not never_null, "default": c.default, "auto_increment": c.auto_increment, "comment": c.comment})
    return {"columns": fields, "constraints": [asdict(r) for r in rules], "parts": [], "rows": 0}


class Tables:
    """Reads and changes tables of one transaction's state."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    # -- reading

    @staticmethod
    def column_type(column: dict[str, Any]) -> ColumnType:
        return parse_type(column["type"])

    def schema(self, table: dict[str, Any]) -> T.StructType:
        return T.StructType([T.StructField(c["name"], self.column_type(c).spark, True, {"type": c["type"]}) for c in table["columns"]])

    def frame(self, table: dict[str, Any], parts: list[dict[str, Any]] | None = None, with_part: bool = False, with_place: bool = False) -> DataFrame:
        """The rows of a table or of some of its parts; ``with_part`` adds the folder they lie in, ``with_place`` the file
        and the number of the row in it."""
        schema = self.schema(table)
        parts = table["parts"] if parts is None else parts
        by_fill: dict[str, list[str]] = {}
        for p in parts:
            by_fill.setdefault(str(sorted(p["fill"].items())), []).append(p)
        frames = []
        for group in by_fill.values():
            rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{p['path']}" for p in group))
            fill = group[0]["fill"]
            picked = [F.expr(fill[f.name]).cast(f.dataType).alias(f.name) if f.name in fill else F.col(quoted(f.name)) for f in schema]
            if with_part:
                picked.append(F.regexp_extract("_metadata.file_path", "data/[0-9a-f]{32}", 0).alias("__part"))
            if with_place:
                picked += [F.regexp_extract("_metadata.file_path", "data/[0-9a-f]{32}/.*", 0).alias("__file"), F.col("_metadata.row_index").alias("__row")]
            frames.append(rows.select(*picked))
        if not frames:
            extra = [T.StructField("__part", T.StringType())] if with_part else []
            extra += [T.StructField("__file", T.StringType()), T.StructField("__row", T.LongType())] if with_place else []
            return self.spark.createDataFrame([], T.StructType([*schema.fields, *extra]))
        return reduce(DataFrame.unionByName, frames)

    # -- writing

    def _write(self, table: dict[str, Any], rows: DataFrame, sort_by: list[str]) -> tuple[dict[str, Any], int]:
        """Write rows as a new folder; within files they are sorted by the index columns, which lets the
        Parquet reader skip row groups on point and range filters."""
        path = f"data/{uuid.uuid4().hex}"
        narrow = rows.select(*(quoted(c["name"]) for c in table["columns"]))
        written = Observation()
        (narrow.sortWithinPartitions(*map(quoted, sort_by)) if sort_by else narrow).observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.root}/{path}")
        count = written.get["rows"]
        return {"path": path, "fill": {}, "rows": count}, count

    def compact(self, table: dict[str, Any], sort_by: list[str], most: int = MOST_PARTS) -> None:
        """Size-tiered: once a table has ``most`` parts, its smaller half becomes one part.

        A row is rewritten a number of times logarithmic in the number of inserts.
        """
        if len(table["parts"]) < most:
            return
        small = sorted(table["parts"], key=lambda p: p.get("rows", 0))[: max(most // 2, 2)]
        paths = {p["path"] for p in small}
        part, _ = self._write(table, self.frame(table, small), sort_by)
        table["parts"] = [p for p in table["parts"] if p["path"] not in paths] + [part]

    def _sort_columns(self, txn: Transaction, name: str) -> list[str]:
        database, bare = txn.split(name)
        return next((i["columns"] for i in database["indexes"].values() if i["table"].lower() == bare.lower()), [])

    def cast_rows(self, table: dict[str, Any], rows: DataFrame) -> DataFrame:
        """Rows with the table's columns and types; missing columns get their default, numbers their turn."""
        given = {c.lower(): c for c in rows.columns}
        unknown = set(given) - {c["name"].lower() for c in table["columns"]}
        if unknown:
            raise CatalogProblem(f"no column {', '.join(sorted(unknown))}")
        out = []
        for c in table["columns"]:
            kind = self.column_type(c)
            source = given.get(c["name"].lower())
            value = F.col(quoted(source)) if source else F.lit(None)
            if not source and c["default"] is not None:
                value = F.expr(c["default"])
            if c["auto_increment"]:
                value = self._numbered(table, c["name"], value)
            elif kind.info.name == "time" and source and isinstance(rows.schema[source].dataType, T.StringType):
                value = F.unix_micros(F.concat(F.lit("1970-01-01 "), value).cast("timestamp"))
            out.append(value.cast(kind.spark).alias(c["name"]))
        return rows.select(*out)

    def _numbered(self, table: dict[str, Any], column: str, value: Column) -> Column:
        """Given numbers, and for NULLs numbers above all used ones: increasing, without a global sort."""
        last = self.frame(table).agg(F.max(quoted(column))).first()[0] or 0
        return F.coalesce(value.cast("long"), F.lit(last) + 1 + F.monotonically_increasing_id())

    def insert(self, txn: Transaction, name: str, rows: DataFrame) -> int:
        """Append rows in one step: all of them, or none if any breaks a constraint."""
        table = txn.get("tables", name)
        part, count = self._write(table, self.cast_rows(table, rows), self._sort_columns(txn, name))
        fresh = self.frame(table, [part])
        self._check_rows(table, name, fresh)
        self._check_keys(table, name, fresh, self.frame(table))
        table["parts"].append(part)
        table["rows"] += count
        self.compact(table, self._sort_columns(txn, name))
        self._check_parents(txn, table, name, fresh)  # a row may name a row of its own statement
        return count

    def rewrite(self, txn: Transaction, name: str, marked: Callable[[DataFrame], DataFrame], assign: dict[str, Column] | None, places: bool = False) -> tuple[int, DataFrame, DataFrame | None]:
        """Delete (``assign`` is None) or update the rows that ``marked`` flags true in column ``__hit``; with ``places`` it sees where each row lies.

        Gives their number, the rows as they were and, for an update, as they are now.
        """
        table = txn.get("tables", name)
        names = [c["name"] for c in table["columns"]]
        hits = marked(self.frame(table, with_part=True, with_place=places)).filter(HIT)
        touched = {r[0]: r[1] for r in hits.groupBy("__part").count().toLocalIterator()}
        if not touched:
            empty = self.frame(table, [])
            return 0, empty, empty
        old_parts = [p for p in table["parts"] if p["path"] in touched]
        old = marked(self.frame(table, old_parts, with_place=places))
        before = old.filter(HIT).select(*map(quoted, names))
        if assign is None:
            now, after = old.filter(~F.col(HIT)), None
        else:
            kinds = {c["name"]: self.column_type(c).spark for c in table["columns"]}
            # both branches read the row as it was, so assignments may swap columns
            changed = [F.when(F.col(HIT), assign[n].cast(kinds[n])).otherwise(F.col(quoted(n))).alias(n) if n in assign else F.col(quoted(n)) for n in names]
            now = old.select(*changed, HIT)
            after = now.filter(HIT).drop(HIT)
        part, count = self._write(table, now, self._sort_columns(txn, name))
        kept = [p for p in table["parts"] if p["path"] not in touched]
        table["parts"] = kept + ([part] if count else [])
        total = sum(touched.values())
        table["rows"] -= total if assign is None else 0
        return total, before, after

    # -- changes with their consequences

    def delete(self, txn: Transaction, name: str, marked: Callable[[DataFrame], DataFrame], places: bool = False) -> int:
        count, before, _ = self.rewrite(txn, name, marked, None, places)
        if count:
            self._follow(txn, name, before, "on_delete", None)
        return count

    def update(self, txn: Transaction, name: str, marked: Callable[[DataFrame], DataFrame], assign: dict[str, Column], places: bool = False) -> int:
        table = txn.get("tables", name)
        known = {c["name"].lower(): c["name"] for c in table["columns"]}
        if unknown := [c for c in assign if c.lower() not in known]:
            raise CatalogProblem(f"no column {', '.join(unknown)} in {name}")
        assign = {known[c.lower()]: v for c, v in assign.items()}
        count, before, after = self.rewrite(txn, name, marked, assign, places)
        if not count:
            return 0
        self._check_rows(table, name, after)
        for rule in table["constraints"]:
            if rule["kind"] in ("primary", "unique") and set(rule["columns"]) & set(assign):
                # only keys that the update wrote can occur twice; they are looked up, the others are not shuffled
                written = after.select(*map(quoted, rule["columns"]))
                same = self.frame(table).select(*map(quoted, rule["columns"])).join(written, rule["columns"], "left_semi")
                C.require_none(C.duplicate_keys(same, rule["columns"]), f"{name}: {rule['kind']} key {rule['columns']} is not unique")
        self._check_parents(txn, table, name, after, set(assign))
        self._follow(txn, name, before, "on_update", assign)
        return count

    def _follow(self, txn: Transaction, name: str, before: DataFrame, when: str, assign: dict[str, Column] | None) -> None:
        """Apply the referential actions of the tables, in any database, that name this one."""
        parent = txn.get("tables", name)
        for child_name, child, rule in txn.children(name):
            keys = rule["parent_columns"] or self._primary_key(parent)
            if assign is not None and not set(keys) & set(assign):
                continue
            left = self.frame(parent).select(*map(quoted, keys))
            gone = before.select(*map(quoted, keys)).distinct().join(left, keys, "left_anti")
            held = C.restricted(self.frame(child), rule["columns"], gone, keys)
            if rule[when] == "RESTRICT":
                C.require_none(held, f"{child_name} refers to rows of {name}")
                continue
            if held.isEmpty():
                continue
            mark = self._mark_keys(rule["columns"], gone, keys)
            if rule[when] == "SET NULL":
                self.update(txn, child_name, mark, {c: F.lit(None) for c in rule["columns"]})
            elif assign is None:
                self.delete(txn, child_name, mark)
            else:
                moved = {c: assign[k] for c, k in zip(rule["columns"], keys, strict=True) if k in assign}
                swap = dict(zip(keys, rule["columns"], strict=True))
                self.update(txn, child_name, self._mark_moved(rule["columns"], gone, keys, moved), {c: F.col(f"__new_{swap[k]}") for k, c in swap.items() if k in assign})

    @staticmethod
    def _mark_keys(columns: list[str], gone: DataFrame, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
        flags = gone.select(*(F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(keys))).withColumn(HIT, F.lit(True))

        def mark(rows: DataFrame) -> DataFrame:
            test = reduce(lambda a, b: a & b, (F.col(quoted(c)) == F.col(f"__k{i}") for i, c in enumerate(columns)))
            return rows.join(flags, test, "left").withColumn(HIT, F.coalesce(HIT, F.lit(False)))

        return mark

    @staticmethod
    def _mark_moved(columns: list[str], gone: DataFrame, keys: list[str], moved: dict[str, Column]) -> Callable[[DataFrame], DataFrame]:
        """Like ``_mark_keys``, with the parent's new key values beside each child row."""
        news = [v.alias(f"__new_{c}") for c, v in moved.items()]
        flags = gone.select(*(F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(keys)), *news).withColumn(HIT, F.lit(True))

        def mark(rows: DataFrame) -> DataFrame:
            test = reduce(lambda a, b: a & b, (F.col(quoted(c)) == F.col(f"__k{i}") for i, c in enumerate(columns)))
            return rows.join(flags, test, "left").withColumn(HIT, F.coalesce(HIT, F.lit(False)))

        return mark

    # -- checks

    @staticmethod
    def _primary_key(table: dict[str, Any]) -> list[str]:
        key = next((r["columns"] for r in table["constraints"] if r["kind"] == "primary"), None)
        if key is None:
            raise CatalogProblem("the parent has no primary key; name its columns")
        return key

    def _check_rows(self, table: dict[str, Any], name: str, rows: DataFrame) -> None:
        """NOT NULL, lengths and CHECK, counted in one pass over the new rows."""
        tests: list[tuple[str, Column]] = []
        for c in table["columns"]:
            if not c["nullable"]:
                tests.append((f"{name}.{c['name']} cannot be NULL", F.col(quoted(c["name"])).isNull()))
            if (longest := self.column_type(c).max_length) is not None:
                tests.append((f"{name}.{c['name']} is longer than {longest}", F.length(quoted(c["name"])) > longest))
        for rule in table["constraints"]:
            if rule["kind"] == "check":
                tests.append((f"{name}: check ({rule['check']}) fails", ~F.coalesce(F.expr(rule["check"]), F.lit(True))))
        if tests:
            counts = rows.agg(*(F.count_if(t).alias(f"t{i}") for i, (_, t) in enumerate(tests))).first()
            if broken := [m for (m, _), n in zip(tests, counts, strict=True) if n]:
                raise C.Violation("; ".join(broken))

    def _check_keys(self, table: dict[str, Any], name: str, fresh: DataFrame, old: DataFrame) -> None:
        for rule in table["constraints"]:
            if rule["kind"] in ("primary", "unique"):
                message = f"{name}: {rule['kind']} key {rule['columns']} is not unique"
                C.require_none(C.duplicate_keys(fresh, rule["columns"]), message)
                C.require_none(C.existing_keys(fresh, old, rule["columns"]), message)

    def _check_parents(self, txn: Transaction, table: dict[str, Any], name: str, rows: DataFrame, changed: set[str] | None = None) -> None:
        for rule in table["constraints"]:
            if rule["kind"] == "foreign" and (changed is None or changed & set(rule["columns"])):
                parent = txn.get("tables", ".".join(txn.parent(txn.place(name)[0], rule)))
                keys = rule["parent_columns"] or self._primary_key(parent)
                # of the parents only those that the rows name take part, found without shuffling the others
                named = rows.select(*(F.col(quoted(c)).alias(k) for c, k in zip(rule["columns"], keys, strict=True)))
                parents = self.frame(parent).select(*map(quoted, keys)).join(named, keys, "left_semi")
                C.require_none(C.foreign_key_violations(rows, rule["columns"], parents, keys), f"{name}: {rule['columns']} has no parent in {rule['parent']}")

    def check_existing(self, txn: Transaction, name: str, rule: dict[str, Any]) -> None:
        """Whether the rows that a table has already keep a constraint that is to be added."""
        table = txn.get("tables", name)
        rows = self.frame(table)
        if rule["kind"] == "primary":
            C.require_none(C.primary_key_violations(rows, rule["columns"]), f"{name}: rows break the primary key")
        elif rule["kind"] == "unique":
            C.require_none(C.duplicate_keys(rows, rule["columns"]), f"{name}: rows are not unique")
        elif rule["kind"] == "check":
            C.require_none(C.check_violations(rows, rule["check"]), f"{name}: rows fail the check")
        else:
            self._check_parents(txn, {**table, "constraints": [rule]}, name, rows)
