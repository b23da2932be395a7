"""Projects, permissions and the dataset catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.functions.text import template_fields
from annolytics.operators.status import progress

ADMIN = "system_admin"
PATCHABLE = ("color", "tags", "instructions", "ml_enabled", "ml_url", "ml_annotator", "ml_mode")


def projects_for_user(projects: DataFrame, permissions: DataFrame, user_id: str | None = None) -> DataFrame:
    """Projects with the role a user has in them; for every user when none is named."""
    granted = permissions if user_id is None else permissions.where(F.col("user_id") == user_id)
    return projects.join(granted, "project_id")


def projects_visible(projects: DataFrame, permissions: DataFrame, users: DataFrame, user_id: str) -> DataFrame:
    """Projects a user sees: all, without a role, for a system admin, else the permitted ones."""
    admin = users.where((F.col("user_id") == user_id) & (F.col("global_role") == ADMIN))
    roles = permissions.where(F.col("user_id") == user_id).select("project_id", "role")
    is_admin = admin.exists()
    return (
        projects.join(roles, "project_id", "left")
        .withColumn("_admin", is_admin)
        .where(F.col("_admin") | F.col("role").isNotNull())
        .withColumn("role", F.when(~F.col("_admin"), F.col("role")))
        .drop("_admin")
    )


def visibility_grants(permissions: DataFrame, users: DataFrame) -> DataFrame:
    """Who sees what, for all users at once: ``(user_id, scope, project_id, role)``.

    An admin sees every project: one row of scope ``all`` says so. Other users have a row of
    scope ``project`` per permission. Writing out admins times projects would say no more.
    """
    admins = users.where(F.col("global_role") == ADMIN).select(
        "user_id", F.lit("all").alias("scope"), F.lit(None).cast("string").alias("project_id"), F.lit(None).cast("string").alias("role")
    )
    others = users.where(F.col("global_role") != ADMIN).select("user_id")
    granted = permissions.join(others, "user_id", "left_semi").select(
        "user_id", F.lit("project").alias("scope"), "project_id", "role"
    )
    return admins.unionByName(granted)


def project_detail(
    projects: DataFrame, catalog: DataFrame, templates: DataFrame, annotations: DataFrame, me: str
) -> DataFrame:
    """Projects with their dataset's size, template, label fields and progress."""
    counts = ("annotated_rows", "annotated_by_me", "total_annotations")
    return (
        projects.join(catalog.select("dataset_id", "num_rows"), "dataset_id", "left")
        .join(templates.select("template_id", F.col("source").alias("template_source")), "template_id", "left")
        .join(progress(annotations, me), "project_id", "left")
        .withColumn("annotation_fields", template_fields(F.col("template_source")))
        .withColumn("num_rows", F.coalesce("num_rows", F.lit(0).cast("bigint")))
        .withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})
    )


def role_map(users: DataFrame, permissions: DataFrame) -> DataFrame:
    """Users, one row each, with a map of their roles by project, null for none. A user has at most one role in a project."""
    entries = permissions.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("project_id", "role"))).alias("_entries"))
    return users.join(entries, "user_id", "left").withColumn("project_roles", F.map_from_entries("_entries")).drop("_entries")


def contains_ignoring_case(column: Column, text: str) -> Column:
    """Null-safe, case-insensitive substring test; an empty text passes everything."""
    if not text:
        return F.lit(True)
    return F.coalesce(F.lower(column).contains(text.lower()), F.lit(False))


def search_projects(projects: DataFrame, name: str = "", tags: str = "") -> DataFrame:
    """Projects whose name and tags both contain the texts."""
    return projects.where(contains_ignoring_case(F.col("name"), name) & contains_ignoring_case(F.col("tags"), tags))


def search_catalog(catalog: DataFrame, text: str) -> DataFrame:
    """Datasets whose name or source contains the text."""
    return catalog.where(contains_ignoring_case(F.col("name"), text) | contains_ignoring_case(F.col("source"), text))


def project_patch(projects: DataFrame, patches: DataFrame) -> DataFrame:
    """Projects after a batch of patches (one per project): given fields replace, nulls keep.

    The name is always part of a patch; a blank one rejects the patch as a whole.
    """
    given = [c for c in PATCHABLE if c in patches.columns and c in projects.columns]
    accepted = patches.where(F.trim("name") != "").select(
        "project_id", *[F.col(c).alias(f"_{c}") for c in ("name", *given)]
    )
    changed = {c: F.coalesce(f"_{c}", c) for c in ("name", *given)}
    return projects.join(accepted, "project_id", "left").withColumns(changed).drop(*[f"_{c}" for c in changed])
