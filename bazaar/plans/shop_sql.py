"""The shop mapping (FIXTURES.md section 2) as DuckDB SQL common table
expressions, placed in front of every oracle query."""

from __future__ import annotations

from bazaar.sources.tables import PROMO_ROWS, ROLE_ROWS, STATUS_ROWS

AS_OF_SQL = "TIMESTAMP '2024-01-15 00:00:00'"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return str(v)
    if hasattr(v, "strftime"):
        return f"TIMESTAMP '{v.strftime('%Y-%m-%d %H:%M:%S')}'"
    return "'" + str(v).replace("'", "''") + "'"


def _values(rows, casts) -> str:
    body = ",\n    ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST(c{i} AS {t}) AS {n}" for i, (n, t) in enumerate(casts))
    names = ", ".join(f"c{i}" for i in range(len(casts)))
    return f"SELECT {cols} FROM (VALUES\n    {body}) v({names})"


CTES = {
    "Categories": """SELECT CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS CategoryID,
           p_type AS CategoryName
    FROM (SELECT DISTINCT p_type FROM part) x""",
    "Products": """SELECT p_partkey AS ProductID, p_name AS ProductName,
           concat(p_brand, ' ', p_type, ' size ', CAST(p_size AS VARCHAR)) AS Description,
           CategoryID, CAST(p_retailprice AS DECIMAL(10,2)) AS Price,
           CAST(p_size - 1 AS INTEGER) AS StockQuantity,
           CASE WHEN p_partkey % 5 <> 0
                THEN concat('C:/shop/images/', CAST(p_partkey AS VARCHAR), '.jpg') END AS ImageURL
    FROM part JOIN Categories ON p_type = CategoryName""",
    "Users": """SELECT c_custkey AS UserID, c_name AS Username, CAST(NULL AS VARCHAR) AS PasswordHash,
           concat(lower(c_name), '@example.com') AS Email
    FROM customer""",
    "Roles": _values(ROLE_ROWS, [("RoleID", "BIGINT"), ("RoleName", "VARCHAR")]),
    "UserRoles": """SELECT c_custkey AS UserID, CAST(2 AS BIGINT) AS RoleID FROM customer WHERE c_custkey % 50 <> 49
    UNION ALL
    SELECT c_custkey, CAST(1 AS BIGINT) FROM customer WHERE c_custkey % 20 = 0""",
    "OrderStatuses": _values(STATUS_ROWS, [("StatusID", "BIGINT"), ("StatusCode", "VARCHAR"),
                                           ("DisplayName", "VARCHAR")]),
    "Promocodes": _values(PROMO_ROWS, [("PromoID", "BIGINT"), ("Code", "VARCHAR"),
                                       ("DiscountPercent", "INTEGER"), ("IsGlobal", "BOOLEAN"),
                                       ("CategoryID", "BIGINT"), ("ValidFrom", "TIMESTAMP"),
                                       ("ValidTo", "TIMESTAMP")]),
    "shop_orders": """SELECT o_orderkey AS OrderID, o_custkey AS UserID,
           CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 8 + 1 AS BIGINT) END AS PromoID,
           CAST(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS BIGINT) AS StatusID
    FROM orders""",
    "OrderItems": """SELECT l_orderkey AS OrderID, l_partkey AS ProductID,
           CAST(l_quantity AS INTEGER) AS Quantity, CAST(l_extendedprice AS DECIMAL(10,2)) AS UnitPrice
    FROM lineitem""",
    "CartEvents": """SELECT event_id, ts, user_id AS UserID,
           CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS ProductID,
           CASE event_type WHEN 'click' THEN 'delta' WHEN 'error' THEN 'set' ELSE 'remove' END AS op,
           CAST(CASE event_type WHEN 'click' THEN event_id % 5 - 1
                                WHEN 'error' THEN event_id % 4 END AS INTEGER) AS qty
    FROM events WHERE event_type IN ('click', 'error', 'signup')""",
    "Favorites": """SELECT user_id AS UserID, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS ProductID
    FROM events WHERE event_type = 'view'""",
    "ShopUsers": """SELECT UserID FROM UserRoles JOIN Roles USING (RoleID) WHERE RoleName = 'User'""",
    # D2 written with window SQL: the last reset (set or remove) per key,
    # then the reset value plus the deltas after it.
    "GatedEvents": """SELECT * FROM CartEvents WHERE UserID IN (SELECT UserID FROM ShopUsers)""",
    "CartFold": """SELECT e.*,
           max(CASE WHEN op <> 'delta' THEN struct_pack(t := ts, i := event_id) END)
             OVER (PARTITION BY UserID, ProductID) AS last_reset
    FROM GatedEvents e""",
    "CartItems": """SELECT UserID, ProductID, CAST(Quantity AS INTEGER) AS Quantity FROM (
      SELECT UserID, ProductID,
             COALESCE(max(CASE WHEN op = 'set' AND struct_pack(t := ts, i := event_id) = last_reset
                               AND qty > 0 THEN qty END), 0)
             + COALESCE(sum(CASE WHEN op = 'delta' AND (last_reset IS NULL
                                 OR struct_pack(t := ts, i := event_id) > last_reset) THEN qty END), 0) AS Quantity,
             count(CASE WHEN op = 'delta' AND (last_reset IS NULL
                        OR struct_pack(t := ts, i := event_id) > last_reset) THEN 1 END) AS deltas_after,
             max(CASE WHEN op = 'set' AND struct_pack(t := ts, i := event_id) = last_reset
                      AND qty > 0 THEN 1 ELSE 0 END) AS kept_by_set
      FROM CartFold GROUP BY UserID, ProductID) f
    WHERE deltas_after > 0 OR kept_by_set = 1""",
}


def with_shop(select_sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query over the shop tables with the mapping CTEs (plus
    query-specific ones in ``extra``, which may use the shop tables)."""
    ctes = dict(CTES)
    ctes.update(extra or {})
    body = ",\n".join(f"{name} AS (\n    {sql}\n)" for name, sql in ctes.items())
    return f"WITH RECURSIVE {body}\n{select_sql}"
