"""Crawl planning: what the portal's answers say to fetch next, and what is done.

Fetching itself is an external service; a source for it plugs in where the
frontier is consumed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.tables import stored

LEAF_TEMPLATE, LEAF_PATH = 3, "/uslugi/"


def tree_paths(edges: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """(node, path, depth) of every node below the roots, by a recursive query.

    edges are (parent, child, title), roots (node, title); a node reached by
    several paths has a row for each.
    """
    spark = edges.sparkSession
    edges.createOrReplaceTempView("quern_tree_edges")
    roots.createOrReplaceTempView("quern_tree_roots")
    return spark.sql(
        f"""WITH RECURSIVE walk(node, path, depth) MAX RECURSION LEVEL {most} AS (
              SELECT node, title, 0 FROM quern_tree_roots
              UNION ALL
              SELECT e.child, concat(w.path, ' > ', e.title), w.depth + 1 FROM walk w JOIN quern_tree_edges e ON e.parent = w.node)
            SELECT node, path, depth FROM walk"""
    )


def menu_edges(nodes: DataFrame) -> DataFrame:
    """(parent, child, title) of one level of menus (id, title, children: array of (id, title))."""
    return nodes.select(F.col("id").alias("parent"), F.inline("children")).select("parent", F.col("id").alias("child"), "title")


def menu_leaves(menus: DataFrame) -> DataFrame:
    """Leaf categories (id, title, url, template): by template and path, each id once, at its first place."""
    kept = menus.where((F.col("template") == LEAF_TEMPLATE) & F.contains("url", F.lit(LEAF_PATH)))
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("n = 1").drop("n")


def category_services(categories: DataFrame) -> DataFrame:
    """(id_category, id_service, name): the short name, else the name, trimmed."""
    one = categories.select("id_category", F.inline("services"))
    return one.select("id_category", F.col("idService").alias("id_service"), F.trim(F.coalesce(F.nullif("shortName", F.lit("")), "name", F.lit(""))).alias("name"))


def service_variations(services: DataFrame) -> DataFrame:
    """(id_service, id_variation); zero and null are none."""
    one = services.select("id_service", F.explode("variations").alias("id_variation"))
    return one.where(F.coalesce("id_variation", F.lit(0)) != 0)


@dataclass(frozen=True)
class Portal:
    """Addresses of a portal's three calls.  Parameters' names and order are fixed values: archives are keyed by address."""

    base: str
    menus_path: str
    category_path: str
    service_path: str  # with %s for the service
    language: int = 1

    def _at(self, path: str) -> str:
        return self.base.rstrip("/") + path

    def menus(self) -> Column:
        return F.lit(f"{self._at(self.menus_path)}?ln={self.language}")

    def category(self, category: Column) -> Column:
        return F.concat(F.lit(f"{self._at(self.category_path)}?idC="), category.cast("string"), F.lit(f"&idL={self.language}"))

    def service(self, service: Column, category: Column, variation: Column) -> Column:
        """No variation, or zero, is left empty."""
        v = F.when(F.coalesce(variation.cast("string"), F.lit("")).isin("", "0"), "").otherwise(variation.cast("string"))
        path = F.format_string(self._at(self.service_path), service.cast("string"))
        return F.concat(path, F.lit("?idSC="), category.cast("string"), F.lit("&idV="), v, F.lit(f"&idL={self.language}&idr="))


NODE = "title string, children array<string>, menuItems array<string>, fullUrl string, idTmpl int, idSiteMap long"


def menu_categories(menus: DataFrame, column: str, most: int = 100) -> DataFrame:
    """(id_category, full_url, title, path) of a nested menu's service leaves, each id once, at its first place.

    One level of nodes is opened at a time, in all menus and branches together.
    """
    root = F.coalesce(F.from_json(column, "menus array<string>")["menus"], F.from_json(F.when(F.col(column).startswith("["), F.col(column)), "array<string>"), F.array(column))
    level = menus.select(F.posexplode(root).alias("i", "node")).select(F.array("i").alias("at"), F.lit(None).cast("string").alias("path"), "node")
    leaves = []
    for _ in range(most):
        n = level.select("at", "path", F.from_json("node", NODE).alias("n"))
        here = F.concat_ws(" > ", "path", F.nullif(F.col("n.title"), F.lit("")))
        kids = F.when(F.size("n.children") > 0, F.col("n.children")).when(F.size("n.menuItems") > 0, F.col("n.menuItems"))
        read = stored(n.select("at", here.alias("path"), "n.title", "n.fullUrl", "n.idTmpl", "n.idSiteMap", kids.alias("kids")), "menu")
        leaves.append(read.where("kids IS NULL").drop("kids"))
        level = read.where("kids IS NOT NULL").select("at", "path", F.posexplode("kids").alias("i", "node")).select(F.concat("at", F.array("i")).alias("at"), "path", "node")
        if level.isEmpty():
            break
    kept = reduce(DataFrame.unionByName, leaves).where((F.col("idTmpl") == LEAF_TEMPLATE) & F.contains("fullUrl", F.lit(LEAF_PATH)) & F.col("idSiteMap").isNotNull())
    first = kept.groupBy(F.col("idSiteMap").alias("id_category")).agg(F.min_by(F.struct("fullUrl", "title", "path"), "at").alias("x"))
    return first.select("id_category", F.col("x.fullUrl").alias("full_url"), "x.title", "x.path")


def first_services(listed: DataFrame, limit: int | None = None) -> DataFrame:
    """(id_service, id_category, pos) of the lists (id_category, id_service, pos): each service in its first category; at most `limit` first ones."""
    first = listed.groupBy("id_service").agg(F.min(F.struct("pos", "id_category")).alias("x")).select("id_service", "x.id_category", "x.pos")
    return first.orderBy("pos", "id_service").limit(limit) if limit is not None else first


MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("key", T.StringType()), ("status", T.StringType()), ("http_status", T.IntegerType()), ("bytes", T.LongType()), ("sha256", T.StringType()), ("fetched_at", T.StringType()), ("error", T.StringType()))])


def done_keys(log: DataFrame, key: str = "key", status: str = "status", ok: str = "ok") -> DataFrame:
    """Keys with any ok; filtered before the distinct, or a first failure would hide a later success."""
    return log.where(F.col(status) == ok).select(key).distinct()


def latest(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last row of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return log.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def frontier(wanted: DataFrame, log: DataFrame, key: str = "key") -> DataFrame:
    """What is wanted and not done, each key once: also children of parents that are done."""
    return wanted.dropDuplicates([key]).join(done_keys(log, key), key, "left_anti")
