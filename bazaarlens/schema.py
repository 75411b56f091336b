"""Schemas of the catalogue's tables and of the feeds that fill them.  Money is DECIMAL(10,3)."""

from __future__ import annotations

MONEY = "decimal(10,3)"
TABLES = {
    "products": "id bigint, canonical_name string, brand string, category string, image_url string, description string, match_category string, match_attributes map<string,string>",
    "product_aliases": (
        "id bigint, product_id bigint, store_id bigint, store_product_name string, store_product_id string, store_product_url string, delisted_at timestamp, "
        "match_confidence double, match_method string, condition string, battery_health int, has_damage boolean, damage_notes string, warranty_months int, listing_notes string"
    ),
    "prices": f"id bigint, alias_id bigint, price {MONEY}, currency string, availability boolean, delivery_cost {MONEY}, last_updated timestamp, checked_at timestamp",
    "price_history": f"id bigint, alias_id bigint, price {MONEY}, recorded_at timestamp",
    "stores": "id bigint, name string, website string, is_active int, owner_user_id bigint, is_verified boolean, verified_at timestamp, rejected_at timestamp, created_at timestamp",
    "contact_events": "id bigint, store_id bigint, product_id bigint, channel string, created_at timestamp",
    "price_alerts": f"id bigint, user_id bigint, product_id bigint, target_price {MONEY}, is_active boolean, notified_at timestamp, created_at timestamp",
    "wishlist_items": "id bigint, user_id bigint, product_id bigint, created_at timestamp",
    "users": "id bigint, email string, role string, created_at timestamp, email_verified_at timestamp",
    "scrape_jobs": "id bigint, status string, store_codes string, requested_by bigint, created_at timestamp, started_at timestamp, finished_at timestamp, result string, error string",
    "support_messages": "id bigint, email string, subject string, body string, user_id bigint, created_at timestamp, handled boolean",
    "listing_photos": "id bigint, alias_id bigint, content_type string, width int, height int, byte_size bigint, checksum string, uploaded_at timestamp",
}

#: One landed answer of a shop's server; an unrecorded request has status 599.
LANDED = "store string, target string, page int, url string, status_code int, text string, content_type string"
SHOPIFY = (
    "struct<products:array<struct<id:bigint,title:string,handle:string,vendor:string,product_type:string,images:array<struct<src:string>>,"
    "variants:array<struct<id:bigint,sku:string,price:string,available:boolean,title:string>>>>>"
)
WOOCOMMERCE = (
    "array<struct<id:bigint,name:string,type:string,sku:string,is_in_stock:boolean,permalink:string,images:array<struct<src:string>>,"
    "prices:struct<price:string,currency_code:string,currency_minor_unit:int>>>"
)
