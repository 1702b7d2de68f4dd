"""Users and roles: J10 user_roles, J11 users_with_role, L5 primary_role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def users_with_role(user_roles: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """UserIDs that hold ``role`` (the gate in front of most calls).

    Returns one row per (user, role) pair; callers use it as the right
    side of a ``left_semi`` join, so duplicates never multiply rows.
    """
    wanted = roles.filter(F.col("RoleName") == role).select("RoleID")
    return user_roles.join(wanted, "RoleID", "left_semi").select("UserID")


def role_gate(df: DataFrame, user_roles: DataFrame, roles: DataFrame, role: str = "User") -> DataFrame:
    """Keep rows of users holding ``role`` (EXISTS ... as a semi join)."""
    return df.join(users_with_role(user_roles, roles, role), "UserID", "left_semi")


def user_roles(users: DataFrame, user_roles_df: DataFrame, roles: DataFrame,
               username: str | None = None) -> DataFrame:
    """One row per (user, role) -- the data part of login."""
    u = users.select("UserID", "Username", "Email")
    if username is not None:
        u = u.filter(F.col("Username") == username)
    return (u.join(user_roles_df, "UserID", "inner")
            .join(roles, "RoleID", "inner")
            .select("UserID", "Username", "Email", "RoleName"))


def primary_role(roles_per_user: DataFrame) -> DataFrame:
    """One row per user, 'Admin' before any other role, then by name.

    A plain aggregate (``min_by``) instead of a window: partial
    aggregation keeps a user with many roles from landing whole in one
    task.
    """
    rank = F.struct((F.col("RoleName") != F.lit("Admin")).alias("not_admin"), F.col("RoleName"))
    return (roles_per_user.groupBy("UserID")
            .agg(F.min_by(F.struct("Username", "Email", "RoleName"), rank).alias("r"))
            .select("UserID", "r.Username", "r.Email", "r.RoleName"))
