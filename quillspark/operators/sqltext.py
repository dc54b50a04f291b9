"""Analyses of SQL text: statements are read, not run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import word_in
from .usage import half_up

#: Operations in order of precedence: (operation, pattern, category, severity).
MIGRATIONS = [
    ("DROP TABLE", r"(?i)\bdrop\s+table\b", "destructive", "high"),
    ("DROP COLUMN", r"(?i)\balter\s+table\s+\S+\s+drop\s+column\b", "destructive", "high"),
    ("DROP INDEX", r"(?i)\bdrop\s+index\b", "destructive", "medium"),
    ("DROP CONSTRAINT", r"(?i)\balter\s+table\s+\S+\s+drop\s+constraint\b", "destructive", "medium"),
    ("TRUNCATE", r"(?i)\btruncate\s+\S", "destructive", "high"),
    ("ADD COLUMN", r"(?i)\balter\s+table\s+\S+\s+add\s+column\b", "modifying", "low"),
    ("ALTER TABLE ADD", r"(?i)\balter\s+table\s+\S+\s+add\s", "modifying", "low"),
    ("ALTER COLUMN", r"(?i)\balter\s+table\s+\S+\s+alter\s+column\b", "modifying", "medium"),
    ("RENAME", r"(?i)\balter\s+table\s+\S+\s+rename\b", "modifying", "medium"),
    ("CREATE TABLE", r"(?i)\bcreate\s+table\b", "additive", "low"),
    ("CREATE INDEX", r"(?i)\bcreate\s+(unique\s+)?index\b", "additive", "low"),
    ("CREATE VIEW", r"(?i)\bcreate\s+(or\s+replace\s+)?(materialized\s+)?view\b", "additive", "low"),
]


def migration_operation(line: Column) -> Column:
    """Struct (operation, category, severity) of the first operation that a line matches; null for blank and comment lines."""
    out = F.lit(None).cast("struct<operation:string,category:string,severity:string>")
    for op, pattern, category, severity in reversed(MIGRATIONS):
        out = F.when(line.rlike(pattern), F.struct(F.lit(op).alias("operation"), F.lit(category).alias("category"), F.lit(severity).alias("severity"))).otherwise(out)
    return F.when(~F.trim(line).startswith("--") & (F.trim(line) != ""), out)


def dml_finding(line: Column) -> Column:
    """The rule that a statement's line breaks, or null."""
    bounded = line.rlike(r"(?i)\bwhere\b")
    return (
        F.when(line.rlike(r"(?i)\bdelete\s+from\b") & ~bounded, "delete-without-where")
        .when(line.rlike(r"(?i)\bupdate\s+\S+\s+set\b") & ~bounded, "update-without-where")
        .when(line.rlike(r"(?i)\bselect\s+\*"), "select-star")
    )


def reference_class(line: Column) -> Column:
    """How a line refers to a table."""
    return (
        F.when(line.rlike(r"(?i)\b(alter|drop|create)\s+table\b"), "ddl").when(line.rlike(r"(?i)\bcreate\s+(or\s+replace\s+)?view\b"), "view")
        .when(line.rlike(r"(?i)\breferences\b"), "fk").otherwise("dml")
    )


def table_references(lines: DataFrame, line: str, names: list[str]) -> DataFrame:
    """The rows of ``lines`` that name one of the tables as a whole word, with ``table_name`` and ``reference``."""
    hits = F.filter(F.array(*[F.when(word_in(F.col(line), n), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return lines.select("*", F.explode(hits).alias("table_name")).withColumn("reference", reference_class(F.col(line)))


#: Columns that tools add and drift ignores.
AUDIT_COLUMNS = ["created_at", "updated_at", "deleted_at", "created_by", "updated_by"]


def drift(orm: DataFrame, sql: DataFrame) -> DataFrame:
    """``(table_name, column_name, drift)`` of two schemas ``(table_name, column_name, type)``, types by family."""
    a = orm.select("table_name", "column_name", F.col("type").alias("orm_type"))
    b = sql.select("table_name", "column_name", F.col("type").alias("sql_type"))
    both = a.join(b, ["table_name", "column_name"], "full_outer")
    kind = F.when(F.col("sql_type").isNull(), "extra_in_orm").when(F.col("orm_type").isNull(), "extra_in_sql").when(F.col("orm_type") != F.col("sql_type"), "type_mismatch")
    return both.where(~F.col("column_name").isin(AUDIT_COLUMNS)).withColumn("drift", kind).where("drift is not null").select("table_name", "column_name", "drift")


def lint(columns: DataFrame, wide: int = 20) -> DataFrame:
    """Findings over ``(table_name, column_name, is_primary)``: tables without a primary key, and wide ones."""
    per = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("is_primary").cast("int")).alias("pk"))
    found = F.filter(F.array(F.when(F.col("pk") == 0, F.lit("no-primary-key")), F.when(F.col("n") > wide, F.lit("wide-table"))), lambda x: x.isNotNull())
    return per.select("table_name", F.explode(found).alias("rule"))


def schema_complexity(columns: DataFrame, keys: DataFrame, indexes: DataFrame) -> DataFrame:
    """Columns + 3 foreign keys + 1.5 indexes, per table."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("table_name").agg(F.count(F.lit(1)).alias(name))

    both = count(columns, "columns").join(count(keys, "fks"), "table_name", "left").join(count(indexes, "indexes"), "table_name", "left")
    fks, idx = F.coalesce("fks", F.lit(0)), F.coalesce("indexes", F.lit(0))
    return both.select("table_name", (F.col("columns") + 3 * fks + 1.5 * idx).alias("score"))


def index_coverage(keys: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: foreign-key columns with an index by all of them, in percent with one digit; 100 without any."""
    k = keys.select("table_name", "column_name").distinct()
    covered = k.join(indexed.select("table_name", "column_name").distinct(), ["table_name", "column_name"], "left_semi").agg(F.count(F.lit(1)).alias("c"))
    return k.agg(F.count(F.lit(1)).alias("n")).crossJoin(covered).select(F.when(F.col("n") == 0, 100.0).otherwise(half_up(100 * F.col("c") / F.col("n"), 1)).alias("coverage"))
