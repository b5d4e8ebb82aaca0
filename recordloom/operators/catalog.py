"""Collections of workspaces: a catalog DataFrame ``(id, workspace_id, name, description)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.errors import Conflict, MissingObject

# Fixed value: name and description of the collection every workspace has.
DEFAULT_NAME = "default"

COLUMNS = ("id", "workspace_id", "name", "description")


def collections_of(catalog: DataFrame, workspace_id: str) -> DataFrame:
    """Collections of a workspace, by name."""
    return catalog.filter(F.col("workspace_id") == workspace_id).orderBy("name", "id")


def default_collections(catalog: DataFrame) -> DataFrame:
    """Collections that carry their workspace's own id."""
    return catalog.filter(F.col("id") == F.col("workspace_id"))


def find_collections(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Collections named by ``(workspace_id, id)``; one in another workspace is not found."""
    return catalog.join(wanted.select("workspace_id", "id").distinct(), ["workspace_id", "id"], "left_semi")


def ensure_defaults(catalog: DataFrame, workspaces: DataFrame) -> DataFrame:
    """The catalog with a default collection for each of ``workspaces.workspace_id``."""
    asked = workspaces.select("workspace_id").distinct()
    lacking = asked.join(default_collections(catalog).select("workspace_id"), "workspace_id", "left_anti")
    name = F.lit(DEFAULT_NAME)
    new = lacking.select(
        F.col("workspace_id").alias("id"), "workspace_id", name.alias("name"), name.alias("description")
    )
    return catalog.select(*COLUMNS).unionByName(new)


def name_conflicts(catalog: DataFrame) -> DataFrame:
    """Names used more than once in a workspace: ``(workspace_id, name, collections)``."""
    counted = catalog.groupBy("workspace_id", "name").agg(F.count(F.lit(1)).alias("collections"))
    return counted.filter(F.col("collections") > 1)


def add_collections(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """The catalog with new collections; ids and names must be free."""
    if not new.join(catalog.select("id"), "id", "left_semi").isEmpty():
        raise Conflict("a collection id is taken")
    return _checked(catalog.select(*COLUMNS).unionByName(new.select(*COLUMNS)))


def update_collections(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """The catalog with names and descriptions changed; each must exist in its workspace."""
    keys = ["workspace_id", "id"]
    if not updates.join(catalog.select(*keys), keys, "left_anti").isEmpty():
        raise MissingObject("a collection to update does not exist")
    changed = updates.select(*keys, F.col("name").alias("new_name"), F.col("description").alias("new_description"))
    joined = catalog.join(changed.withColumn("hit", F.lit(True)), keys, "left")
    return _checked(
        joined.select(
            "id", "workspace_id",
            F.when(F.col("hit"), F.col("new_name")).otherwise(F.col("name")).alias("name"),
            F.when(F.col("hit"), F.col("new_description")).otherwise(F.col("description")).alias("description"),
        )
    )


def drop_collections(catalog: DataFrame, asked: DataFrame) -> DataFrame:
    """The catalog without collections; each must belong to the workspace named with it."""
    keys = ["workspace_id", "id"]
    if not asked.join(catalog.select(*keys), keys, "left_anti").isEmpty():
        raise Conflict("a collection does not belong to the specified workspace")
    return catalog.join(asked.select("id"), "id", "left_anti").select(*COLUMNS)


def _checked(catalog: DataFrame) -> DataFrame:
    if not name_conflicts(catalog).isEmpty():
        raise Conflict("a collection name is used twice in a workspace")
    return catalog
