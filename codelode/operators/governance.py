"""Roles, audit events read and removed (see audit for their chains), and bearer tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Permissions, and which each role has.
PERMISSIONS = "TENANT_ADMIN KEY_ROTATE MEMBER_READ MEMBER_WRITE WORKSPACE_READ WORKSPACE_WRITE BINDING_WRITE AUDIT_READ RETENTION_MANAGE".split()
ROLES = {
    "OWNER": PERMISSIONS, "ADMIN": [p for p in PERMISSIONS if p != "KEY_ROTATE"], "CONTRIBUTOR": ["MEMBER_READ", "WORKSPACE_READ", "WORKSPACE_WRITE", "BINDING_WRITE"], "VIEWER": ["MEMBER_READ", "WORKSPACE_READ"], "AUDITOR": ["MEMBER_READ", "WORKSPACE_READ", "AUDIT_READ"],
}
MAX_LIFETIME, MAX_SKEW, MAX_MEMBERS, MAX_EVENTS, PREFIX = 24 * 3600, 60, 1024, 100_000, "cl1"


def role_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, own in ROLES.items() for p in own], "role string, permission string")


def authorize(requests: DataFrame, members: DataFrame) -> DataFrame:
    """requests (request_id, tenant_id, principal_id, permission) with allowed: whether the principal's role in the tenant has the permission; unknown principals have none."""
    matrix = F.broadcast(role_matrix(requests.sparkSession).withColumn("allowed", F.lit(True)))
    found = requests.join(members.select("tenant_id", "principal_id", "role"), ["tenant_id", "principal_id"], "left").join(matrix, ["role", "permission"], "left")
    return found.select("request_id", "tenant_id", "principal_id", "permission", "role", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def upsert_members(members: DataFrame, changes: DataFrame, most: int = MAX_MEMBERS) -> DataFrame:
    """members after changes (tenant_id, principal_id, role; a null role revokes). A tenant without an owner or with more than most members is an error when the result is read."""
    kept = members.join(changes.select("tenant_id", "principal_id"), ["tenant_id", "principal_id"], "left_anti")
    after = kept.unionByName(changes.filter("role IS NOT NULL").select("tenant_id", "principal_id", "role"))
    sums = after.groupBy("tenant_id").agg(F.count_if(F.col("role") == "OWNER").alias("owners"), F.count("*").alias("members"))
    checked = after.join(sums, "tenant_id")
    fine = (F.col("owners") > 0) & (F.col("members") <= most)
    return checked.select("tenant_id", "principal_id", F.when(fine, F.col("role")).otherwise(F.raise_error(F.concat(F.lit(f"tenant needs an owner and at most {most} members: "), "tenant_id"))).alias("role"))


def newest_events(events: DataFrame, tenant: str, limit: int = 100) -> DataFrame:
    return events.filter(F.col("tenant_id") == tenant).orderBy(F.desc("sequence")).limit(limit)


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def issue_token(key: bytes, tenant: str, principal: str, key_id: str, issued: int, lifetime: int, token_id: str) -> str:
    if not 0 < lifetime <= MAX_LIFETIME:
        raise ValueError("a token lives more than 0 and at most 24 hours")
    claims = {"tenant": tenant, "principal": principal, "key": key_id, "issued": issued, "expires": issued + lifetime, "id": token_id}
    body = _b64(json.dumps(claims, sort_keys=True, separators=(",", ":")).encode())
    return f"{PREFIX}.{body}.{_b64(hmac.new(key, body.encode(), hashlib.sha256).digest())}"


def authenticate(key: bytes, token: str, now: int) -> dict:
    """A token's claims; PermissionError for anything but a whole, current token in its one spelling."""
    parts = token.split(".")
    if len(parts) != 3 or parts[0] != PREFIX or not hmac.compare_digest(_b64(hmac.new(key, parts[1].encode(), hashlib.sha256).digest()), parts[2]):
        raise PermissionError("invalid token")
    claims = json.loads(base64.urlsafe_b64decode(parts[1] + "=" * (-len(parts[1]) % 4)))
    if claims["issued"] > now + MAX_SKEW or claims["expires"] <= now or claims["expires"] - claims["issued"] > MAX_LIFETIME:
        raise PermissionError("invalid token")
    return claims


def cutoff(now, days: int):
    """The time before which so many days of history end."""
    return now - F.make_interval(days=F.lit(days))


def apply_retention(events: DataFrame, removals: DataFrame, workspaces: DataFrame, archived_before) -> tuple[DataFrame, DataFrame]:
    """Events without the first ones that removals (tenant_id, remove) counts, and workspaces without those archived before a time."""
    first = events.groupBy("tenant_id").agg(F.min("sequence").alias("low"))
    cut = removals.join(first, "tenant_id").select("tenant_id", (F.col("low") + F.col("remove")).alias("keep_from"))
    kept = events.join(cut, "tenant_id", "left").filter(F.col("keep_from").isNull() | (F.col("sequence") >= F.col("keep_from"))).drop("keep_from")
    gone = (F.col("status") == "ARCHIVED") & (F.col("archived_at") < archived_before)
    return kept, workspaces.filter(~F.coalesce(gone, F.lit(False)))


def change_workspaces(workspaces: DataFrame, changes: DataFrame) -> DataFrame:
    """workspaces (workspace_id, name, status, archived_at) after changes (workspace_id, name, action, at): CREATE a new one, ARCHIVE an active one. Anything else is an error when the result is read."""
    both = workspaces.join(changes.select("workspace_id", F.col("name").alias("new_name"), "action", "at"), "workspace_id", "full_outer")
    fine = F.col("action").isNull() | ((F.col("action") == "CREATE") & F.col("status").isNull()) | ((F.col("action") == "ARCHIVE") & (F.col("status") == "ACTIVE"))
    status = F.when(F.col("action") == "CREATE", "ACTIVE").when(F.col("action") == "ARCHIVE", "ARCHIVED").otherwise(F.col("status"))
    checked = F.when(fine, status).otherwise(F.raise_error(F.concat(F.lit("workspace can't be changed so: "), "workspace_id")))
    return both.select("workspace_id", F.coalesce("name", "new_name").alias("name"), checked.alias("status"), F.when(F.col("action") == "ARCHIVE", F.col("at")).otherwise(F.col("archived_at")).alias("archived_at"))


def bind(bindings: DataFrame, changes: DataFrame, workspaces: DataFrame) -> DataFrame:
    """bindings (workspace_id, project_id, snapshot_id) after changes of the same columns: one snapshot a project, a null one unbinds; only active workspaces change."""
    open_ = changes.join(workspaces.filter("status = 'ACTIVE'").select("workspace_id"), "workspace_id", "left_semi")
    kept = bindings.join(open_.select("workspace_id", "project_id"), ["workspace_id", "project_id"], "left_anti")
    return kept.unionByName(open_.filter("snapshot_id IS NOT NULL").select(*bindings.columns))
