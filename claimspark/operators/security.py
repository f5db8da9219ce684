"""Which rows a user may see: owners' rows through their projects, all rows for an administrator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.scalars import text_or


def is_admin(profiles: DataFrame, user: object) -> bool:
    return not profiles.filter((F.col("id") == F.lit(user)) & (F.col("role") == "super_admin")).isEmpty()


def visible(rows: DataFrame, projects: DataFrame, user: object, admin: bool = False, project: str = "project_id") -> DataFrame:
    """rows of the user's projects; all for an administrator."""
    if admin:
        return rows
    own = projects.filter(F.col("contractor_id") == F.lit(user)).select(F.col("id").alias(project))
    return rows.join(own, project, "left_semi")


def visible_lists(lists: DataFrame, user: object, admin: bool = False) -> DataFrame:
    """Global lists and the user's own."""
    return lists if admin else lists.filter(F.col("is_global") | (F.col("contractor_id") == F.lit(user)))


def stored_visible(objects: DataFrame, bucket: str = "documents") -> DataFrame:
    """Files of a public bucket: anyone may read them."""
    return objects.filter(F.col("bucket_id") == bucket)


def stored_owned(objects: DataFrame, user: object, bucket: str = "documents") -> DataFrame:
    """Files that the user may change or delete."""
    return stored_visible(objects, bucket).filter(F.col("owner") == F.lit(user))


def owned(projects: DataFrame, user: object) -> DataFrame:
    """The user's projects, newest first."""
    return projects.filter(F.col("contractor_id") == F.lit(user)).orderBy(F.desc_nulls_first("created_at"), "id")


def profiles_of(users: DataFrame, name: str | None = None, company: str | None = None) -> DataFrame:
    """Profiles of new users from their metadata (JSON text); without a name or company the given words, else null."""
    field = lambda k, default: F.get_json_object("metadata", f"$.{k}") if default is None else text_or(F.get_json_object("metadata", f"$.{k}"), F.lit(default))
    return users.select("id", field("full_name", name).alias("full_name"), field("company_name", company).alias("company_name"), F.lit("contractor").alias("role"))
