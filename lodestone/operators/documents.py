"""Document, chunk and area operators: summaries, previews, search, roles, sessions, keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Priority of roles (fixed values).
ROLES = {"reader": 1, "maintainer": 2, "admin": 3}


def role_priority(role: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, p in ROLES.items():
        out = F.when(role == name, p).otherwise(out)
    return out


def effective_roles(principals: DataFrame, user_roles: DataFrame, group_roles: DataFrame) -> DataFrame:
    """(principal, area_id, role): the highest of direct and group roles; no row where there is none.

    principals: principal, group_path (a row per group); user_roles: area_id, principal, role; group_roles: area_id,
    group_path, role.
    """
    direct = principals.select("principal").distinct().join(user_roles, "principal").select("principal", "area_id", "role")
    grouped = principals.join(group_roles, "group_path").select("principal", "area_id", "role")
    both = direct.unionByName(grouped).withColumn("p", role_priority(F.col("role"))).where("p is not null")
    return both.groupBy("principal", "area_id").agg(F.max_by("role", "p").alias("role"))


def access_outcome(requests: DataFrame, roles: DataFrame, minimum: str) -> DataFrame:
    """requests (principal, area_id) with outcome: not_found without a role, forbidden below the minimum, else allow."""
    p = role_priority(F.col("role"))
    out = F.when(p.isNull(), "not_found").when(p < ROLES[minimum], "forbidden").otherwise("allow")
    return requests.join(roles, ["principal", "area_id"], "left").withColumn("outcome", out)


def chunk_summary(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Parents and children per document, zero where there are none."""
    kids = children.groupBy("document_id").agg(F.countDistinct("parent_id").alias("parents"), F.count(F.lit(1)).alias("children"))
    return documents.select("document_id").join(kids, "document_id", "left").fillna(0, ["parents", "children"])


def chunking_diagnostics(children: DataFrame) -> DataFrame:
    """Per document: sections of mixed kinds, and sections that run text, table, text."""
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("child_index", "structure_kind"))), lambda s: s["structure_kind"])
    islands = F.filter(kinds, lambda k, i: (i == 0) | (F.element_at(kinds, F.greatest(i, F.lit(1))) != k))
    sections = children.groupBy("document_id", "section_index").agg(F.size(F.array_distinct(kinds)).alias("n"), islands.alias("runs"))
    cluster = F.col("runs") == F.array(F.lit("text"), F.lit("table"), F.lit("text"))
    return sections.groupBy("document_id").agg(F.sum((F.col("n") > 1).cast("int")).alias("mixed_sections"), F.sum(cluster.cast("int")).alias("table_clusters"))


def merged_runs(children: DataFrame) -> DataFrame:
    """Runs of consecutive children of one kind within a parent, each with its merged text (gaps and islands)."""
    w = Window.partitionBy("parent_id").orderBy("child_index")
    v = Window.partitionBy("parent_id", "structure_kind").orderBy("child_index")
    runs = children.withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    items = F.sort_array(F.collect_list(F.struct("child_index", "content")))
    runs = runs.groupBy("document_id", "parent_id", "structure_kind", "island").agg(F.min("child_index").alias("first_child"), F.count(F.lit(1)).alias("n"), items.alias("items"))
    glue = F.when(F.col("structure_kind") == "table", "\n").otherwise("\n\n")
    text = F.aggregate(F.transform("items", lambda s: F.trim(s["content"])), F.lit(None).cast("string"), lambda a, t: F.when(a.isNull(), t).otherwise(F.concat(a, glue, t)))
    return runs.withColumn("text", text).drop("items", "island")


def search(children: DataFrame, documents: DataFrame, needle: str, limit: int = 10, excerpt: int = 240) -> DataFrame:
    """Ready children whose text matches %needle% without regard to case, by file name and position."""
    hits = children.where("status = 'ready'").where(F.col("content").ilike(f"%{needle}%"))
    named = hits.join(documents.select("document_id", "file_name"), "document_id")
    return named.orderBy("file_name", "position").limit(limit).select("document_id", "file_name", "position", F.substring("content", 1, excerpt).alias("excerpt"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the changes in place of rows of the same keys: an anti-join and a union."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def append_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows whose keys it does not hold."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def delete_cascade(tables: dict[str, DataFrame], key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique, with their row counts."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
