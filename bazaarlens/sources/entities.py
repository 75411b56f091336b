"""The catalogue's entities as views over the star-schema tables.

Each view is one SELECT that Spark and DuckDB both run, so a query and its SQL start from the
same rows: suppliers are shops, parts products (a quarter of them with titles of all kinds,
``sources/titles.py``; some that no shop lists), line items price readings (the newest of a part
and supplier is the current offer, the one before it the price as stored until then; a shop's last
read holds the ``in_read`` ones), events contact taps, orders price alerts and wishes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.session import written
from bazaarlens.sources.titles import TITLES, values

#: Freshness of the synthetic readings: a reading from this time on counts as current.
FRESH = "TIMESTAMP '2000-01-01 00:00:00'"
NOW = "TIMESTAMP '2024-01-30 00:00:00'"

#: Products that no shop lists any more have ids from here on.
UNLISTED = 10_000_000

VIEWS = {
    "stores": """
        SELECT s_suppkey AS id, s_name AS name, CAST(CASE WHEN s_suppkey % 17 = 16 THEN 0 ELSE 1 END AS INT) AS is_active,
               CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS owner_user_id, (s_suppkey % 8 = 0) AS is_verified,
               (s_suppkey % 12 = 4) AS is_rejected
        FROM supplier""",
    "readings": """
        SELECT l_partkey * 100000 + l_suppkey AS alias_id, l_partkey AS product_id, l_suppkey AS store_id,
               CAST(l_extendedprice AS DECIMAL(10,3)) AS price, CAST(l_tax * 100 AS DECIMAL(10,3)) AS delivery_cost, l_linestatus = 'O' AS availability,
               CASE l_returnflag WHEN 'R' THEN 'used' WHEN 'A' THEN 'refurbished' ELSE 'new' END AS condition,
               CASE WHEN l_discount >= 0.09 THEN l_shipdate END AS delisted_at, l_shipdate AS checked_at,
               ROW_NUMBER() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS back,
               l_orderkey AS order_key, l_linenumber AS line_number, l_quantity < 40 AS in_read
        FROM lineitem""",
    "listings": "SELECT alias_id, product_id, store_id, price, delivery_cost, availability, condition, delisted_at, checked_at, in_read FROM readings WHERE back = 1",
    "prices": "SELECT alias_id, product_id, store_id, price, delivery_cost, availability, condition, checked_at FROM readings WHERE back = 2",
    "price_history": "SELECT alias_id, product_id, store_id, price, checked_at AS recorded_at, back, order_key, line_number FROM readings",
    "products": f"""
        SELECT id, coalesce(known.title, y.title) AS canonical_name, CASE WHEN y.golden IS NOT NULL THEN known.category WHEN k = 0 THEN 'phones' WHEN k = 1 THEN 'laptops' ELSE 'monitors' END AS match_category,
               CASE WHEN id % 5 <> 0 THEN concat('https://img.example/', CAST(id AS VARCHAR(12)), '.jpg') END AS image_url, y.golden
        FROM (SELECT id, k, CASE WHEN m % 4 = 3 THEN (m * 5 + k * 13) % {len(TITLES)} END AS golden, CASE k
            WHEN 0 THEN concat(CASE WHEN m % 2 = 0 THEN 'Apple ' ELSE '' END, 'iPhone ', CAST(11 + m % 6 AS VARCHAR(4)),
                CASE m % 8 WHEN 0 THEN '' WHEN 1 THEN ' Pro' WHEN 2 THEN ' Pro Max' ELSE ' Plus' END, ' ',
                CASE m % 3 WHEN 0 THEN '128GB' WHEN 1 THEN '256GB' ELSE '1TB' END, ' ',
                CASE m % 5 WHEN 0 THEN 'Black' WHEN 1 THEN 'Midnight' WHEN 2 THEN 'Midnight Green' WHEN 3 THEN 'Grey' ELSE 'Blue' END)
            WHEN 1 THEN concat('Dell Inspiron ', CAST(5400 + m % 7 AS VARCHAR(6)), ' Laptop Intel Core i', CASE m % 3 WHEN 0 THEN '3' WHEN 1 THEN '5' ELSE '7' END,
                ' ', CASE m % 2 WHEN 0 THEN '8GB' ELSE '16GB' END, ' DDR4 & ', CASE m % 8 WHEN 0 THEN '256GB' WHEN 1 THEN '512GB' ELSE '1TB' END, ' SSD ',
                CASE m % 2 WHEN 0 THEN 'Silver' ELSE 'Black' END)
            ELSE concat('LG UltraGear ', CASE m % 3 WHEN 0 THEN '24' WHEN 1 THEN '27' ELSE '32' END, ' inch ',
                CASE m % 8 WHEN 0 THEN 'FHD' WHEN 1 THEN 'QHD' WHEN 2 THEN '4K' ELSE 'UHD' END, ' ', CASE m % 2 WHEN 0 THEN '75' ELSE '144' END, 'Hz IPS Monitor')
            END AS title
            FROM (SELECT p_partkey AS id, p_partkey % 3 AS k, CAST(floor(p_partkey / 3) AS BIGINT) AS m FROM part
                  UNION ALL SELECT {UNLISTED} + p_partkey, p_partkey % 3, CAST(floor(p_partkey / 3) AS BIGINT) FROM part WHERE p_size = 7) z) y
        LEFT JOIN {values('title', 'category')} ON known.golden = y.golden""",
    "aliases": """
        SELECT r.alias_id, r.product_id, r.store_id, CASE WHEN r.alias_id % 3 <> 0 THEN concat('SB-', CAST(r.alias_id AS VARCHAR(20))) END AS store_product_id, p.canonical_name AS store_product_name,
               concat('https://shop.example/products/old-', CAST(r.alias_id AS VARCHAR(20))) AS store_product_url, 'new' AS condition, CASE WHEN r.delivery_cost > 7 THEN r.checked_at END AS delisted_at, r.checked_at
        FROM prices r JOIN products p ON p.id = r.product_id""",
    "feed": """
        SELECT l.store_id, concat('SB-', CAST(l.alias_id AS VARCHAR(20))) AS store_product_id, p.canonical_name AS name, concat('https://shop.example/products/p', CAST(l.product_id AS VARCHAR(20))) AS url,
               CASE WHEN l.alias_id % 5 = 0 THEN 'Vendor' END AS brand, CASE WHEN l.alias_id % 10 = 0 THEN 'Uncategorized' END AS category, p.image_url, 'new' AS condition,
               l.price, l.availability, l.delivery_cost, l.product_id AS listed_product, l.alias_id AS listed_alias
        FROM listings l JOIN products p ON p.id = l.product_id JOIN stores s ON s.id = l.store_id
        WHERE l.in_read AND s.owner_user_id IS NULL""",
    "landed": """
        SELECT concat('store', CAST(store_id AS VARCHAR(12))) AS store, 'all' AS target, page, 'https://shop.example/products.json' AS url, status_code, text, 'application/json' AS content_type
        FROM (SELECT store_id, CAST(ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY listed_alias) AS INT) AS page, CAST(200 AS INT) AS status_code,
                     concat(chr(123), '"products":[', chr(123), '"id":', CAST(listed_product AS VARCHAR(20)), ',"title":"', replace(name, chr(34), concat(chr(92), chr(34))), '","handle":"p', CAST(listed_product AS VARCHAR(20)),
                            '","vendor":"', coalesce(brand, ''), '","product_type":"","body_html":"long","images":[', chr(123), '"src":"', coalesce(image_url, ''), '","width":900', chr(125), '],"variants":[', chr(123), '"id":', CAST(listed_alias AS VARCHAR(20)),
                            ',"sku":" ', store_product_id, '","price":"', CAST(price AS VARCHAR(20)), '","available":', CASE WHEN availability THEN 'true' ELSE 'false' END, ',"title":"Default Title"', chr(125), ']', chr(125), ']', chr(125)) AS text
              FROM feed
              UNION ALL SELECT store_id, CAST(count(*) + 1 AS INT), CAST(CASE WHEN store_id % 5 = 1 THEN 503 ELSE 200 END AS INT),
                     CASE WHEN store_id % 5 = 2 THEN 'busy' WHEN store_id % 5 = 3 THEN '[]' ELSE concat(chr(123), '"products":[]', chr(125)) END
              FROM feed WHERE store_id % 7 <> 5 GROUP BY store_id) x""",
    "answers": """
        SELECT store_id, concat('https://shop.example/products/p', CAST(product_id AS VARCHAR(20))) AS url,
               CAST(CASE WHEN delisted_at IS NOT NULL THEN 404 WHEN store_id % 5 = 1 AND NOT availability THEN 503 ELSE 200 END AS INT) AS status_code,
               concat(chr(123), '"handle":"p', CAST(product_id AS VARCHAR(20)), CASE WHEN condition = 'used' THEN '-used' ELSE '' END, '","variants":[', chr(123), '"id":', CAST(alias_id AS VARCHAR(20)),
                      ',"sku":"', CASE WHEN in_read THEN concat(' SB-', CAST(alias_id AS VARCHAR(20))) ELSE 'another' END, '"', chr(125), ']', chr(125)) AS text
        FROM listings""",
    "landed_woo": """
        SELECT concat('store', CAST(store_id AS VARCHAR(12))) AS store, 'all' AS target, CAST(ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY listed_alias) AS INT) AS page,
               'https://shop.example/wp-json/wc/store/v1/products' AS url, CAST(200 AS INT) AS status_code,
               concat('[', chr(123), '"id":', CAST(listed_alias AS VARCHAR(20)), ',"name":"', replace(replace(name, '&', '&amp;'), chr(34), concat(chr(92), chr(34))), ' &#8211; new","type":"', CASE WHEN image_url IS NULL THEN 'variable' ELSE 'simple' END,
                      '","sku":" ', CASE WHEN brand IS NULL THEN store_product_id ELSE '' END, '","is_in_stock":', CASE WHEN availability THEN 'true' ELSE 'false' END, ',"permalink":"', url, '","images":[', chr(123), '"src":"', coalesce(image_url, ''), '"', chr(125),
                      '],"prices":', chr(123), '"price":"', CAST(CAST(price * 1000 AS BIGINT) AS VARCHAR(20)), '","currency_code":"', CASE WHEN category IS NULL THEN 'JOD' ELSE 'USD' END, '","currency_minor_unit":3', chr(125), chr(125), ']') AS text,
               'application/json' AS content_type
        FROM feed""",
    "robots": """
        SELECT concat('store', CAST(id AS VARCHAR(12)), '.example') AS host,
               concat('User-agent: *', chr(10), 'Disallow: /products/p', CAST(id AS VARCHAR(12)), ' # these', chr(10), 'Allow: /products/p', CAST(id AS VARCHAR(12)), '7$', chr(10), 'Disallow: /*?', chr(10), chr(10), 'User-agent: other', chr(10), 'Disallow: /') AS text
        FROM stores""",
    "contact_events": """
        SELECT event_id AS id, user_id % (SELECT count(*) FROM supplier) AS store_id,
               CASE WHEN event_id % 7 <> 0 THEN CAST({json}(props, '$.k') AS BIGINT) END AS product_id,
               CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'whatsapp' WHEN 'purchase' THEN 'facebook' WHEN 'signup' THEN 'instagram' ELSE 'call' END AS channel,
               ts AS created_at
        FROM events""",
    "price_alerts": """
        SELECT o_orderkey AS id, o_custkey AS user_id, l_partkey AS product_id, CAST(o_totalprice / 2 AS DECIMAL(10,3)) AS target_price,
               o_orderstatus = 'O' AS is_active, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS notified_at, o_orderdate AS created_at
        FROM (SELECT o.*, l.l_partkey, ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, o_custkey) AS rn
              FROM orders o JOIN lineitem l ON o_orderkey = l_orderkey) x
        WHERE rn = 1""",
    "wishlist": "SELECT user_id, product_id, min(created_at) AS created_at FROM price_alerts GROUP BY user_id, product_id",
    "users": "SELECT c_custkey AS id, concat('user', CAST(c_custkey AS VARCHAR(12)), '@example.org') AS email, CASE WHEN c_custkey % 100 = 0 THEN 'admin' ELSE 'user' END AS role, c_custkey % 5 <> 0 AS is_verified FROM customer",
    "identities": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS provider, concat('s', CAST(c_custkey AS VARCHAR(12))) AS provider_subject, c_custkey AS user_id FROM customer WHERE c_custkey % 3 = 0",
    "sign_ins": """
        SELECT event_id AS id, ts AS at, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'second' END AS provider, concat('s', CAST(user_id AS VARCHAR(12))) AS provider_subject,
               CASE WHEN event_id % 13 <> 0 THEN concat(' ', CASE WHEN user_id % 5 = 1 THEN concat('New', CAST(user_id % 50 AS VARCHAR(12))) ELSE concat('User', CAST(user_id AS VARCHAR(12))) END, '@Example.org') END AS email, event_id % 4 <> 0 AS email_verified
        FROM events""",
    "support": "SELECT event_id AS id, CASE WHEN event_id % 4 <> 0 THEN user_id END AS user_id, event_id % 3 = 0 AS handled, ts AS created_at FROM events WHERE event_type IN ('signup', 'error')",
    "photos": "SELECT alias_id * 100 + back AS id, alias_id, date_trunc('year', checked_at) AS uploaded_at FROM readings WHERE product_id % 3 <> 0 AND NOT in_read",
    "applied": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'SUPPLIER' ELSE 'supplier' END || CASE WHEN c_custkey % 2 = 0 THEN '#' ELSE '_' END || lpad(CAST(c_custkey AS VARCHAR(12)), 9, '0') AS name FROM customer",
}

#: Base tables that a view reads.
USES = {
    "stores": ("supplier",), "readings": ("lineitem",), "products": ("part",), "contact_events": ("events", "supplier"), "price_alerts": ("orders", "lineitem"), "users": ("customer",),
    "identities": ("customer",), "sign_ins": ("events",), "support": ("events",), "applied": ("customer",),
}
#: Views that a view reads.
PARENTS = {
    "listings": ("readings",), "prices": ("readings",), "price_history": ("readings",), "wishlist": ("price_alerts",),
    "aliases": ("prices", "products"), "feed": ("listings", "products", "stores"), "landed": ("feed",), "landed_woo": ("feed",), "answers": ("listings",), "robots": ("stores",), "photos": ("readings",),
}
#: Views whose readings come by product: readings of a shop and product are ranked, and met with products, where they are.
BY_PRODUCT = ("feed", "aliases")
JSON_VALUE = {"spark": "get_json_object", "duckdb": "json_extract_string"}


class Entities:
    """The views of one input folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str, held: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.sf_dir, self.held = spark, sf_dir, held or {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def holding(self, *names: str) -> Entities:
        """The same views, of which the named ones are computed here and read by all that start from them."""
        out = self
        for name in names:
            out = Entities(self.spark, self.sf_dir, out.held | {name: written(out._view(name, True))})
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self._view(name, False)

    def _view(self, name: str, by_product: bool) -> DataFrame:
        if name in self.held:
            return self.held[name]
        by_product = by_product or name in BY_PRODUCT
        inner = {p: self._view(p, by_product) for p in PARENTS.get(name, ())} or {b: self.base(b) for b in USES[name]}
        if name == "readings" and by_product:
            inner["lineitem"] = inner["lineitem"].repartition("l_partkey")
        sql = VIEWS[name].replace("{json}", JSON_VALUE["spark"])
        for k in sorted(inner, key=len, reverse=True):  # frames are passed by name, without views in the session
            sql = _placed(sql, k)
        return self.spark.sql(sql, **inner)


def _placed(sql: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)


def with_views(names: tuple[str, ...], sql: str) -> str:
    """DuckDB SQL with the named views, and those they need, in a WITH clause before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for parent in PARENTS.get(name, ()):
            add(parent)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    views = ",\n".join(f"{n} AS ({VIEWS[n].replace('{json}', JSON_VALUE['duckdb'])})" for n in order)
    sql = sql.strip()
    if not order:
        return sql
    return f"WITH {views}{', ' + sql[5:] if sql.upper().startswith('WITH ') else chr(10) + sql}"
