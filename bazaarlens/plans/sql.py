"""DuckDB SQL of the registered queries: the views each starts from, and what it selects."""

from __future__ import annotations

from bazaarlens.functions import terms
from bazaarlens.functions.spelling import arabic_vocabulary, vocabulary
from bazaarlens.sources.entities import FRESH, NOW
from bazaarlens.sources.titles import values

M = "DECIMAL(18,3)"

# Offers that count now, with total and group; several queries start from them.
OFFERS = f"""
    offers AS (
        SELECT l.*, s.name AS store_name, s.owner_user_id, CAST(l.price + l.delivery_cost AS {M}) AS total,
               CASE WHEN coalesce(l.condition, 'new') = 'new' THEN 'new' ELSE 'second_hand' END AS grp
        FROM listings l JOIN stores s ON s.id = l.store_id
        WHERE s.is_active = 1 AND (s.owner_user_id IS NULL OR s.is_verified) AND l.delisted_at IS NULL
          AND (s.owner_user_id IS NOT NULL OR l.checked_at >= {FRESH}))"""
LOWEST = "lowest AS (SELECT product_id, min(total) AS lowest FROM offers WHERE availability AND grp = 'new' GROUP BY product_id)"

# Attributes of the titles: of the three plain kinds by rules of their own, of the others as written down with them.
ATTRIBUTES = ("brand", "model", "variant", "cpu", "storage", "ram", "size", "resolution", "refresh", "panel", "color")
PARSED = f"""
    t AS (SELECT *, lower(canonical_name) AS n FROM products),
    plainly AS (
        SELECT id,
               CASE match_category WHEN 'phones' THEN 'apple' WHEN 'laptops' THEN 'dell' ELSE 'lg' END AS brand,
               CASE match_category WHEN 'phones' THEN concat('iphone ', regexp_extract(n, 'iphone (\\d+)', 1)) WHEN 'laptops' THEN concat('inspiron ', regexp_extract(n, 'inspiron (\\d+)', 1)) END AS model,
               CASE WHEN match_category = 'phones' THEN CASE WHEN n LIKE '% pro max %' THEN 'pro max' WHEN n LIKE '% pro %' THEN 'pro' WHEN n LIKE '% plus %' THEN 'plus' ELSE 'base' END END AS variant,
               CASE WHEN match_category = 'laptops' THEN regexp_extract(n, '(i\\d) ', 1) END AS cpu,
               CASE WHEN match_category <> 'monitors' THEN CASE WHEN n LIKE '%1tb%' THEN '1024gb' WHEN match_category = 'phones' THEN regexp_extract(n, '(\\d+gb)', 1) ELSE regexp_extract(n, '(\\d+gb) ssd', 1) END END AS storage,
               CASE WHEN match_category = 'laptops' THEN regexp_extract(n, '(\\d+gb) ddr4', 1) END AS ram,
               CASE WHEN match_category = 'monitors' THEN regexp_extract(n, '(\\d+) inch', 1) END AS size,
               CASE WHEN match_category = 'monitors' THEN CASE WHEN n LIKE '%uhd%' OR n LIKE '% 4k %' THEN '4k' WHEN n LIKE '%qhd%' THEN '2k' ELSE 'fhd' END END AS resolution,
               CASE WHEN match_category = 'monitors' THEN regexp_extract(n, '(\\d+)hz', 1) END AS refresh,
               CASE WHEN match_category = 'monitors' THEN 'ips' END AS panel,
               CASE WHEN match_category = 'monitors' THEN NULL WHEN n LIKE '%midnight green' THEN 'midnight green' WHEN n LIKE '%midnight' OR n LIKE '%black' THEN 'black'
                    WHEN n LIKE '%grey' THEN 'gray' WHEN n LIKE '%blue' THEN 'blue' WHEN n LIKE '%silver' THEN 'silver' END AS color
        FROM t WHERE golden IS NULL),
    parsed AS (
        SELECT t.id, t.canonical_name, t.match_category, t.image_url, t.golden, t.match_category AS category, {', '.join(f'CASE WHEN t.golden IS NULL THEN plainly.{a} ELSE known.{a} END AS {a}' for a in ATTRIBUTES)}
        FROM t LEFT JOIN plainly ON plainly.id = t.id LEFT JOIN {values(*ATTRIBUTES)} ON known.golden = t.golden)"""
RANKED = "ranked AS (SELECT product_id, min(total) AS lowest, count(DISTINCT store_id) AS store_count FROM offers WHERE availability AND grp = 'new' GROUP BY product_id)"
# The head of the name tells families of products without a model apart.
FAMILIES = f"""{OFFERS}, {RANKED}, {PARSED},
    keyed AS (
        SELECT p.id AS product_id, p.match_category, p.image_url, r.lowest,
               concat_ws('|', p.match_category, p.brand, coalesce(p.model, '-'), coalesce(p.variant, '-'), coalesce(p.storage, '-'), coalesce(p.ram, '-'),
                         CASE WHEN p.model IS NULL THEN trim(regexp_replace(lower(split_part(p.canonical_name, ',', 1)), '[^a-z0-9]+', ' ', 'g')) ELSE '' END) AS family
        FROM parsed p JOIN ranked r ON r.product_id = p.id WHERE p.match_category IS NOT NULL),
    fam AS (
        SELECT product_id, match_category, image_url, lowest, variants FROM (
            SELECT *, count(*) OVER (PARTITION BY family) AS variants, row_number() OVER (PARTITION BY family ORDER BY image_url IS NULL, lowest, product_id) AS rn FROM keyed) WHERE rn = 1)"""
SCORED = f"""{OFFERS}, {LOWEST}, {PARSED},
    asked(query_id, category, brand, model, variant, cpu, storage, size, refresh, color) AS (VALUES
        (1, 'phones', 'apple', 'iphone 11', 'pro', NULL, '128gb', NULL, NULL, 'black'), (2, 'monitors', 'lg', NULL, NULL, NULL, NULL, '27', '144', NULL),
        (3, 'laptops', 'dell', 'inspiron laptop', NULL, 'i5', '512gb', NULL, NULL, NULL)),
    weights(category, attribute, weight) AS (VALUES ('phones', 'model', 33), ('phones', 'variant', 28), ('phones', 'storage', 24), ('phones', 'color', 10), ('monitors', 'size', 32), ('monitors', 'refresh', 22),
        ('laptops', 'model', 30), ('laptops', 'cpu', 20), ('laptops', 'storage', 20)),
    match AS (
        SELECT q.query_id, p.id AS product_id, CAST(100 - coalesce(sum(w.weight), 0) AS DOUBLE) AS score, count(w.weight) AS n_different
        FROM asked q JOIN parsed p ON p.category = q.category AND p.brand = q.brand
        LEFT JOIN weights w ON w.category = q.category AND CASE w.attribute WHEN 'model' THEN q.model IS NOT NULL AND p.model IS DISTINCT FROM q.model WHEN 'variant' THEN q.variant IS NOT NULL AND p.variant IS DISTINCT FROM q.variant
            WHEN 'storage' THEN q.storage IS NOT NULL AND p.storage IS DISTINCT FROM q.storage WHEN 'color' THEN q.color IS NOT NULL AND p.color IS DISTINCT FROM q.color WHEN 'cpu' THEN q.cpu IS NOT NULL AND p.cpu IS DISTINCT FROM q.cpu
            WHEN 'size' THEN q.size IS NOT NULL AND p.size IS DISTINCT FROM q.size ELSE q.refresh IS NOT NULL AND p.refresh IS DISTINCT FROM q.refresh END
        GROUP BY q.query_id, p.id),
    scored AS (
        SELECT m.query_id, m.product_id, l.lowest, m.score, m.n_different, CASE WHEN m.score >= 100 THEN 'exact' WHEN m.score >= 85 THEN 'close' ELSE 'similar' END AS tier
        FROM match m LEFT JOIN lowest l ON l.product_id = m.product_id WHERE m.score >= 70)"""
DELIST = f"""
    scraped AS (SELECT l.* FROM listings l JOIN stores s ON s.id = l.store_id WHERE s.owner_user_id IS NULL),
    read AS (SELECT alias_id FROM listings WHERE in_read),
    marked AS (
        SELECT s.*, r.alias_id IS NOT NULL AS here, s.checked_at >= TIMESTAMP '1999-06-01 00:00:00' AS is_fresh,
               r.alias_id IS NULL AND s.delisted_at IS NULL AND s.store_id % 7 <> 1 AS gone
        FROM scraped s LEFT JOIN read r ON r.alias_id = s.alias_id),
    valve AS (SELECT store_id, count(*) FILTER (WHERE gone AND is_fresh) > greatest(25, floor(count(*) FILTER (WHERE delisted_at IS NULL) * 0.25)) AS refused FROM marked GROUP BY store_id),
    done AS (
        SELECT m.alias_id, m.store_id, v.refused, CASE WHEN here AND delisted_at IS NOT NULL THEN 'relist' WHEN gone AND NOT (refused AND is_fresh) THEN 'delist' ELSE 'keep' END AS action,
               CASE WHEN here THEN NULL WHEN gone AND NOT (refused AND is_fresh) THEN coalesce(delisted_at, {NOW}) ELSE delisted_at END AS delisted_at
        FROM marked m JOIN valve v ON v.store_id = m.store_id)"""
UPDATE = """
    old AS (SELECT alias_id, price, availability, delivery_cost, checked_at AS recorded_at FROM prices),
    seen AS (SELECT alias_id, price, availability, delivery_cost FROM listings WHERE in_read)"""
SAME = " AND ".join(f"k.{a} IS NOT DISTINCT FROM f.{a}" for a in ("category", *ATTRIBUTES))
# What each of the queries asked must come to mean: written down from the rules.
MEANT = """
    meant(query_id, typed, normalized, corrected_query, category, brand, model, variant, storage, color) AS (VALUES
        (1, 'iPhone 15 Pro 256GB', 'iphone 15 pro 256gb', NULL, 'phones', 'apple', 'iphone 15', 'pro', '256gb', NULL),
        (2, 'ipone 15 blak', 'iphone 15 black', 'iphone 15 black', 'phones', 'apple', 'iphone 15', NULL, NULL, 'black'),
        (3, 'smasung galaxy s24 128gb', 'smasung galaxy s24 128gb', NULL, 'phones', 'samsung', 'galaxy s 24', NULL, '128gb', NULL),
        (4, 'ايفون ١٥ ١٢٨ جيجا اسود', 'iphone 15 128 gb black', NULL, 'phones', 'apple', 'iphone 15', NULL, '128gb', 'black'),
        (5, 'playstation', 'playstation', NULL, NULL, NULL, NULL, NULL, NULL, NULL), (6, 'سوني', 'sony', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
        (7, 'iphone a16', 'iphone a16', NULL, 'phones', 'apple', NULL, NULL, NULL, NULL), (8, 'toaster', 'toaster', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
        (9, 'no such thing', 'no such thing', NULL, NULL, NULL, NULL, NULL, NULL, NULL), (10, '   ', '', NULL, NULL, NULL, NULL, NULL, NULL, NULL), (11, '', '', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
        (12, 'galaxy', 'galaxy', NULL, 'phones', 'samsung', NULL, NULL, NULL, NULL), (13, 'xiomi redmi note 15', 'xiomi redmi note 15', NULL, 'phones', 'xiaomi', 'redmi note 15', NULL, NULL, NULL),
        (14, '%', '', NULL, NULL, NULL, NULL, NULL, NULL, NULL))"""
ANSWERS = f"""{OFFERS}, {LOWEST}, {PARSED}, {MEANT},
    offered AS (SELECT * FROM parsed p WHERE EXISTS (SELECT 1 FROM offers o WHERE o.product_id = p.id)),
    structured AS (SELECT m.query_id, p.id FROM meant m JOIN offered p ON p.category = m.category AND (m.brand IS NULL OR p.brand = m.brand)),
    named AS (
        SELECT m.query_id, p.id FROM meant m JOIN offered p ON (
            (trim(coalesce(corrected_query, typed)) <> '' AND (contains(lower(canonical_name), lower(trim(coalesce(corrected_query, typed)))) OR contains(coalesce(p.brand, ''), lower(trim(coalesce(corrected_query, typed))))))
            OR (normalized <> '' AND (contains(lower(canonical_name), normalized) OR contains(coalesce(p.brand, ''), normalized))))
        WHERE m.query_id NOT IN (SELECT query_id FROM structured)),
    held AS (
        SELECT m.query_id, p.id AS product_id, p.canonical_name, m.corrected_query,
               CASE WHEN m.category IS NULL OR m.category IS DISTINCT FROM p.category OR coalesce(m.model, m.variant, m.storage, m.color) IS NULL THEN 0
                    ELSE 100 - CASE WHEN m.model <> coalesce(p.model, '') THEN 33 ELSE 0 END - CASE WHEN m.variant <> coalesce(p.variant, '') THEN 28 ELSE 0 END
                         - CASE WHEN m.storage <> coalesce(p.storage, '') THEN 24 ELSE 0 END - CASE WHEN m.color <> coalesce(p.color, '') THEN 10 ELSE 0 END END AS points,
               CASE WHEN m.model <> coalesce(p.model, '') THEN 1 ELSE 0 END + CASE WHEN m.variant <> coalesce(p.variant, '') THEN 1 ELSE 0 END
               + CASE WHEN m.storage <> coalesce(p.storage, '') THEN 1 ELSE 0 END + CASE WHEN m.color <> coalesce(p.color, '') THEN 1 ELSE 0 END AS n
        FROM (SELECT * FROM structured UNION ALL SELECT * FROM named) c JOIN meant m ON m.query_id = c.query_id JOIN parsed p ON p.id = c.id),
    usable AS (SELECT query_id, max(points) >= 70 AS usable FROM held GROUP BY query_id),
    answers AS (
        SELECT h.query_id, h.product_id, h.canonical_name, h.corrected_query, CASE WHEN NOT usable THEN 'similar' WHEN points >= 100 THEN 'exact' WHEN points >= 85 THEN 'close' ELSE 'similar' END AS tier,
               CAST(CASE WHEN usable THEN points ELSE 0 END AS DOUBLE) AS score, CAST(CASE WHEN usable THEN n ELSE 0 END AS BIGINT) AS n_different
        FROM held h JOIN usable u ON u.query_id = h.query_id WHERE NOT usable OR points >= 70)"""
INGEST = f"""{PARSED},
    known AS (SELECT * FROM parsed WHERE id IN (SELECT product_id FROM aliases)),
    kept AS (SELECT f.store_id, f.store_product_id, f.name, f.url, f.image_url AS picture, f.condition, f.price, f.brand AS vendor, p.id AS listed, p.category, {', '.join(f'p.{a}' for a in ATTRIBUTES)} FROM feed f JOIN parsed p ON p.id = f.listed_product WHERE p.category IS NOT NULL),
    by_sku AS (SELECT store_id, store_product_id, min(alias_id) AS alias_id FROM aliases WHERE store_product_id IS NOT NULL GROUP BY ALL),
    by_name AS (SELECT store_id, store_product_name, condition, min(alias_id) AS alias_id FROM aliases GROUP BY ALL),
    same AS (SELECT f.id AS listed, (SELECT min(k.id) FROM known k WHERE {SAME}) AS product_id FROM parsed f WHERE f.category IS NOT NULL),
    landed AS (
        SELECT f.store_id, f.store_product_id, f.name, f.url, f.picture, f.price, coalesce(lower(f.vendor), f.brand) AS ingest_brand, coalesce(s.alias_id, n.alias_id) AS alias_id, coalesce(a.product_id, i.product_id) AS product_id,
               CASE WHEN s.alias_id IS NOT NULL THEN 'sku' WHEN n.alias_id IS NOT NULL THEN 'name' WHEN i.product_id IS NOT NULL THEN 'identity' ELSE 'canonical' END AS match_method,
               concat_ws('|', f.category, {', '.join(f"coalesce(f.{a}, '-')" for a in ATTRIBUTES)}) AS identity
        FROM kept f LEFT JOIN by_sku s ON s.store_id = f.store_id AND s.store_product_id = f.store_product_id
        LEFT JOIN by_name n ON n.store_id = f.store_id AND n.store_product_name = f.name AND n.condition = f.condition
        LEFT JOIN aliases a ON a.alias_id = coalesce(s.alias_id, n.alias_id) LEFT JOIN same i ON i.listed = f.listed)"""
# One row of letters' runs each, against the words that rules know: the one nearest within the edits allowed.
LETTERS = "'" + r"\p{L}+" + "'"
VOCABULARY = ", ".join(f"('{w}')" for w in vocabulary())
SPELLING = f"""
    typed AS (SELECT id, regexp_replace(lower(canonical_name), 'iphone|monitor|laptop', 'iphon', 'g') AS q FROM products),
    runs AS (SELECT id, unnest(regexp_extract_all(q, {LETTERS})) AS w, generate_subscripts(regexp_extract_all(q, {LETTERS}), 1) AS i, string_split_regex(q, {LETTERS}) AS gaps FROM typed),
    vocabulary(word) AS (VALUES {VOCABULARY}),
    near AS (
        SELECT r.w, v.word, levenshtein(r.w, v.word) AS edits FROM (SELECT DISTINCT w FROM runs) r JOIN vocabulary v
          ON levenshtein(r.w, v.word) <= CASE WHEN length(r.w) <= 3 THEN 0 WHEN length(r.w) <= 5 THEN 1 ELSE 2 END
        WHERE r.w NOT IN (SELECT word FROM vocabulary) AND regexp_matches(r.w, '^[a-z]+$')),
    fixes AS (SELECT w, min(word) AS fixed FROM (SELECT *, min(edits) OVER (PARTITION BY w) AS least FROM near) WHERE edits = least GROUP BY w HAVING count(*) = 1),
    pieces AS (SELECT id, string_agg(gaps[i] || coalesce(fixed, r.w), '' ORDER BY i) || any_value(gaps[len(gaps)]) AS corrected FROM runs r LEFT JOIN fixes f ON f.w = r.w GROUP BY id),
    firsts AS (SELECT id, r.w, fixed, min(i) AS i FROM runs r JOIN fixes f ON f.w = r.w GROUP BY id, r.w, fixed),
    told AS (SELECT id, concat(chr(123), string_agg(concat('"', w, '":"', fixed, '"'), ',' ORDER BY i), chr(125)) AS corrections FROM firsts GROUP BY id)"""
SURVIVORS = "s AS (SELECT id, min(id) OVER (PARTITION BY match_category, brand, model, variant, cpu, storage, ram, size, resolution, refresh, panel, color) AS survivor FROM parsed WHERE match_category IS NOT NULL)"
VERDICT = "CASE WHEN delisted_at IS NOT NULL THEN 'GONE' WHEN store_id % 5 = 1 AND NOT availability THEN 'UNKNOWN' WHEN NOT in_read THEN 'VARIANT_GONE' WHEN condition = 'used' THEN 'RENAMED' ELSE 'OK' END"
# Arabic words as somebody types them: with an edit, two edits, an article, no word nearby, several of one meaning nearby, and right ones.
MISTYPED = ("ايفوون", "سامسنوج", "الايفونن", "شاشهه", "لابتوبب", "جالكسي", "قطار", "اسود", "موبيلات", "هواوى", "تلفيزيون", "الشاشةة")
# DuckDB measures edits in bytes: letters stand for one byte each.
ARABIC = "".join(sorted({c for w in (*arabic_vocabulary(), *MISTYPED, terms.ARABIC_TO) for c in w}))
ONE_BYTE = "".join(chr(65 + k) if k < 26 else chr(71 + k) for k in range(len(ARABIC)))
ARABIC_SPELLING = f"""
    vocabulary(word, meaning) AS (VALUES {", ".join(f"('{w}', {repr(m) if m else 'NULL'})" for w, m in arabic_vocabulary().items())}),
    typed(n, w) AS (VALUES {", ".join(f"({k}, '{w}')" for k, w in enumerate(MISTYPED))}),
    folded AS (SELECT *, translate(w, '{terms.ARABIC_FROM}', '{terms.ARABIC_TO}') AS f FROM typed),
    stems AS (SELECT *, CASE WHEN starts_with(f, '{terms.ARTICLE}') AND length(f) > 4 THEN substr(f, 3) ELSE f END AS stem FROM folded),
    near AS (SELECT s.*, v.word, v.meaning, levenshtein(translate(stem, '{ARABIC}', '{ONE_BYTE}'), translate(word, '{ARABIC}', '{ONE_BYTE}')) AS edits FROM stems s CROSS JOIN vocabulary v
        WHERE f NOT IN (SELECT word FROM vocabulary) AND stem NOT IN (SELECT word FROM vocabulary)),
    least AS (SELECT *, min(edits) OVER (PARTITION BY n) AS least FROM near WHERE edits <= CASE WHEN length(stem) <= 3 THEN 0 WHEN length(stem) <= 5 THEN 1 ELSE 2 END),
    fixes AS (SELECT n, any_value(left(f, length(f) - length(stem))) || min(word) AS fixed FROM least WHERE edits = least GROUP BY n
        HAVING count(*) = 1 OR (count(DISTINCT meaning) = 1 AND count(meaning) = count(*)))"""
PSEUDONYM_KEY = "0123456789abcdef"
PADDED = PSEUDONYM_KEY.encode().ljust(64, b"\0")
INNER, OUTER = ("'" + "".join(f"\\x{b ^ pad:02X}" for b in PADDED) + "'::BLOB" for pad in (0x36, 0x5C))
DIFFERS = ", ".join(f"CASE WHEN q.{a} IS NOT NULL AND p.{a} IS DISTINCT FROM q.{a} THEN CASE WHEN p.{a} IS NULL THEN '{label} not stated' ELSE concat('{label} ', p.{a}, ' instead of ', q.{a}) END END" for a, label in (
    ("model", "model"), ("variant", "variant"), ("cpu", "processor"), ("storage", "storage"), ("size", "screen size"), ("refresh", "refresh rate"), ("color", "colour")))
VERDICTS = f"""{DELIST},
    n AS (SELECT store_id, count(*) AS seen, count(*) FILTER (WHERE NOT availability) AS failed FROM feed GROUP BY store_id),
    verdicts AS (SELECT n.store_id, seen, failed, CASE WHEN n.store_id % 7 = 5 OR n.store_id % 5 IN (1, 2, 3) THEN 'incomplete' WHEN 2 * failed > seen THEN 'mostly_failed' WHEN refused THEN 'delist_refused' ELSE 'ok' END AS verdict FROM n JOIN valve v ON v.store_id = n.store_id)"""
CHANNELS = ", ".join(f"count(*) FILTER (WHERE channel = '{c}') AS {c}" for c in ("whatsapp", "call", "facebook", "instagram"))

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "current_offers": (("stores", "listings"), f"WITH {OFFERS} SELECT alias_id, product_id, store_id, store_name, CAST(price AS {M}) AS price, total, availability, grp FROM offers"),
    "price_summary": (("stores", "listings"), f"""WITH {OFFERS}
        SELECT product_id, grp, CAST(min(price) AS {M}) AS lowest_price, CAST(max(price) AS {M}) AS highest_price, min(total) AS lowest_total,
               arg_min(store_name, (total, alias_id)) AS best_store, count(DISTINCT store_id) AS store_count, string_agg(CAST(total AS VARCHAR), ',' ORDER BY total) AS totals
        FROM offers WHERE availability GROUP BY product_id, grp"""),
    "search_cards": (("stores", "listings"), f"""WITH {OFFERS}
        SELECT product_id, CAST(min(price) FILTER (WHERE grp = 'new') AS {M}) AS lowest_price, CAST(max(price) FILTER (WHERE grp = 'new') AS {M}) AS highest_price,
               min(total) FILTER (WHERE grp = 'new') AS lowest_total, arg_min(store_name, (total, alias_id)) FILTER (WHERE grp = 'new') AS best_store,
               count(DISTINCT store_id) FILTER (WHERE grp = 'new') AS store_count, min(total) FILTER (WHERE grp = 'second_hand') AS second_hand_from,
               count(DISTINCT store_id) FILTER (WHERE grp = 'second_hand') AS second_hand_stores
        FROM offers WHERE availability GROUP BY product_id"""),
    "best_savings": (("stores", "listings"), f"""WITH {OFFERS}, g AS (
            SELECT product_id, min(total) AS cheapest, max(total) AS dearest, count(DISTINCT store_id) AS store_count, arg_min(store_name, (total, alias_id)) AS best_store
            FROM offers WHERE availability AND grp = 'new' GROUP BY product_id)
        SELECT product_id, cheapest, dearest, CAST(dearest - cheapest AS {M}) AS saving, store_count, best_store,
               round_even(CAST(dearest - cheapest AS DOUBLE) / CAST(dearest AS DOUBLE) * 100, 1) AS saving_percent
        FROM g WHERE store_count >= 2 AND dearest > cheapest"""),
    "top_deals": (("stores", "listings"), f"""WITH {OFFERS}, g AS (
            SELECT product_id, CAST(max(total) - min(total) AS {M}) AS saving, count(DISTINCT store_id) AS n FROM offers WHERE availability AND grp = 'new' GROUP BY product_id)
        SELECT product_id, saving FROM g WHERE n >= 2 AND saving > 0 ORDER BY saving DESC, product_id LIMIT 20"""),
    "best_deal_store": (("stores", "listings"), f"""WITH {OFFERS}
        SELECT product_id, grp, alias_id, store_name, total FROM (
            SELECT *, row_number() OVER (PARTITION BY product_id, grp ORDER BY total, alias_id) AS rn FROM offers WHERE availability) WHERE rn = 1"""),
    "offered_products": (("stores", "listings", "products"), f"WITH {OFFERS} SELECT id, match_category FROM products p WHERE EXISTS (SELECT 1 FROM offers o WHERE o.product_id = p.id)"),
    "browse_ranked": (("stores", "listings", "products"), f"WITH {OFFERS}, {RANKED} SELECT product_id, match_category, lowest, store_count FROM ranked JOIN products ON id = product_id WHERE match_category IS NOT NULL"),
    "families": (("stores", "listings", "products"), f"WITH {FAMILIES} SELECT product_id, match_category, variants FROM fam"),
    "category_counts": (("stores", "listings", "products"), f"WITH {FAMILIES} SELECT match_category, count(*) AS families FROM fam GROUP BY match_category"),
    "interleaved_browse": (("stores", "listings", "products"), f"""WITH {FAMILIES},
            turns AS (SELECT *, CAST(row_number() OVER (PARTITION BY match_category ORDER BY image_url IS NULL, lowest, product_id) AS INT) AS turn FROM fam)
        SELECT product_id, match_category, turn, (SELECT count(*) FROM fam) AS total, (SELECT count(*) FROM fam) > 30 AS has_more FROM turns ORDER BY turn, CASE match_category WHEN 'phones' THEN 0 WHEN 'laptops' THEN 1 ELSE 2 END LIMIT 24 OFFSET 6"""),
    "seeded_shuffle": (("stores", "listings", "products"), f"""WITH {FAMILIES}
        SELECT product_id, match_category, CAST(row_number() OVER (PARTITION BY match_category ORDER BY image_url IS NULL, md5(concat('7:', match_category, ':', product_id)), product_id) AS INT) AS place FROM fam"""),
    "offers_by_product": (("stores", "listings"), f"WITH {OFFERS} SELECT product_id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY total, alias_id) AS INT) AS place, alias_id, total FROM offers"),
    "history_series": (("stores", "listings", "price_history"), f"""WITH {OFFERS}
        SELECT h.alias_id, o.store_name, CAST(h.price AS {M}) AS price, h.recorded_at, CAST(h.back AS INT) AS back FROM price_history h JOIN offers o ON o.alias_id = h.alias_id"""),
    "history_extents": (("stores", "listings", "price_history"), f"""WITH {OFFERS},
            x AS (SELECT product_id, CAST(min(price) AS {M}) AS low, CAST(max(price) AS {M}) AS high, count(*) AS points FROM price_history GROUP BY product_id),
            o AS (SELECT product_id, min(total) FILTER (WHERE availability AND grp = 'new') AS new_from, min(total) FILTER (WHERE availability AND grp = 'second_hand') AS second_hand_from FROM offers GROUP BY product_id)
        SELECT x.*, o.new_from, o.second_hand_from FROM x LEFT JOIN o ON o.product_id = x.product_id"""),
    "price_anomalies": (("price_history", "products", "stores"), f"""WITH w AS (
            SELECT *, lag(price) OVER (PARTITION BY alias_id ORDER BY recorded_at, order_key, line_number, price) AS previous FROM price_history),
        c AS (SELECT *, round(CAST(abs(price - previous) AS DOUBLE) / CAST(previous AS DOUBLE) * 100, 3) AS change FROM w WHERE recorded_at > {FRESH} AND previous > 0)
        SELECT alias_id, p.canonical_name, s.name AS store_name, CAST(back AS INT) AS back, CAST(price AS {M}) AS price, CAST(previous AS {M}) AS previous, round(change, 1) AS change_percent
        FROM c JOIN products p ON p.id = c.product_id JOIN stores s ON s.id = c.store_id
        WHERE CAST(abs(price - previous) AS DOUBLE) / CAST(previous AS DOUBLE) * 100 > 50"""),
    "contact_totals": (("contact_events",), f"SELECT {CHANNELS}, count(*) AS total FROM contact_events WHERE created_at >= {NOW} - INTERVAL 7 DAY"),
    "contact_by_store": (("stores", "contact_events"), f"""WITH c AS (SELECT store_id, {CHANNELS}, count(*) AS total FROM contact_events WHERE created_at >= {NOW} - INTERVAL 30 DAY GROUP BY store_id)
        SELECT s.id AS store_id, coalesce(whatsapp, 0) AS whatsapp, coalesce(call, 0) AS call, coalesce(facebook, 0) AS facebook, coalesce(instagram, 0) AS instagram, coalesce(total, 0) AS total
        FROM stores s LEFT JOIN c ON c.store_id = s.id"""),
    "contact_top_products": (("contact_events", "products"), """WITH c AS (
            SELECT store_id, product_id, count(*) AS taps FROM contact_events JOIN products p ON p.id = product_id GROUP BY store_id, product_id)
        SELECT store_id, CAST(rank AS INT) AS rank, product_id, taps FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY taps DESC, product_id) AS rank FROM c) WHERE rank <= 10"""),
    "store_overview": (("stores", "listings", "contact_events"), """
        SELECT s.id AS store_id, s.name, CASE WHEN owner_user_id IS NULL THEN 'scraped' WHEN is_verified THEN 'verified' WHEN is_rejected THEN 'rejected' ELSE 'pending' END AS status,
               (SELECT count(*) FROM listings l WHERE l.store_id = s.id) AS listings, (SELECT count(*) FROM contact_events c WHERE c.store_id = s.id) AS taps
        FROM stores s"""),
    "pending_stores": (("stores",), "SELECT id, name FROM stores WHERE owner_user_id IS NOT NULL AND NOT is_verified AND NOT is_rejected"),
    "admin_listings": (("listings", "prices", "products"), f"""
        SELECT a.alias_id, a.store_id, p.canonical_name, CAST(c.price AS {M}) AS price FROM listings a
        LEFT JOIN prices c ON c.alias_id = a.alias_id JOIN products p ON p.id = a.product_id"""),
    "sitemap_rows": (("stores", "listings"), f"""WITH {OFFERS}
        SELECT product_id, max(checked_at) AS changed,
               concat('<url><loc>https://shop.example/product/', product_id, '</loc><lastmod>', strftime(max(checked_at), '%Y-%m-%dT%H:%M:%S+00:00'), '</lastmod></url>') AS xml
        FROM offers GROUP BY product_id HAVING max(CASE WHEN availability THEN 1 ELSE 0 END) = 1"""),
    "category_lastmod": (("stores", "listings", "products"), f"WITH {OFFERS} SELECT match_category, max(checked_at) AS changed FROM offers JOIN products p ON p.id = product_id WHERE grp = 'new' GROUP BY match_category"),
    "catalogue_health": (("stores", "listings"), f"""WITH m AS (SELECT max(checked_at) AS newest FROM listings WHERE store_id IN (SELECT id FROM stores WHERE owner_user_id IS NULL))
        SELECT newest, round((epoch({NOW}) - epoch(newest)) / 3600.0, 1) AS age_hours, CASE WHEN round((epoch({NOW}) - epoch(newest)) / 3600.0, 1) <= 14 THEN 'ok' ELSE 'stale' END AS status FROM m"""),
    "platform_stats": (("products", "stores", "listings", "users", "price_alerts", "contact_events"), " UNION ALL ".join(
        f"SELECT '{name}' AS entity, count(*) AS n FROM {view}" for name, view in (("products", "products"), ("stores", "stores"), ("listings", "listings"), ("users", "users"), ("alerts", "price_alerts"), ("taps", "contact_events")))),
    "remaining_admins": (("users",), "SELECT count(*) AS admins FROM users WHERE role = 'admin' AND is_verified"),
    "wishlist": (("stores", "listings", "products", "wishlist"), f"""WITH {OFFERS}, {LOWEST}
        SELECT w.user_id, w.product_id, p.canonical_name, l.lowest, CAST(row_number() OVER (PARTITION BY w.user_id ORDER BY w.created_at DESC, w.product_id) AS INT) AS place
        FROM wishlist w JOIN products p ON p.id = w.product_id LEFT JOIN lowest l ON l.product_id = w.product_id"""),
    "alerts_met": (("stores", "listings", "price_alerts"), f"""WITH {OFFERS}, {LOWEST}
        SELECT a.id, l.lowest, coalesce(l.lowest <= a.target_price, false) AS is_met,
               greatest(CAST(round(CAST(l.lowest - a.target_price AS DOUBLE) / CAST(nullif(a.target_price, 0) AS DOUBLE) * 100, 0) AS BIGINT), 0) AS gap_percent
        FROM price_alerts a LEFT JOIN lowest l ON l.product_id = a.product_id WHERE a.is_active"""),
    "alert_latch": (("stores", "listings", "price_alerts", "users"), f"""WITH {OFFERS}, {LOWEST}, s AS (
            SELECT a.id, a.notified_at, CASE WHEN l.lowest IS NULL THEN 'keep' WHEN l.lowest > a.target_price AND a.notified_at IS NOT NULL THEN 'reset'
                       WHEN l.lowest <= a.target_price AND a.notified_at IS NULL AND coalesce(u.is_verified, false) THEN 'notify' ELSE 'keep' END AS wanted
            FROM price_alerts a LEFT JOIN lowest l ON l.product_id = a.product_id LEFT JOIN users u ON u.id = a.user_id WHERE a.is_active),
        f AS (SELECT id, notified_at, wanted AS action FROM s)
        SELECT id, action, CASE action WHEN 'notify' THEN {NOW} WHEN 'reset' THEN NULL ELSE notified_at END AS notified_at FROM f"""),
    "duplicate_groups": (("products",), f"""WITH {PARSED}
        SELECT match_category, min(id) AS survivor, count(*) AS members,
               coalesce(arg_max(canonical_name, (length(canonical_name), -id)) FILTER (WHERE canonical_name <> lower(canonical_name)), arg_max(canonical_name, (length(canonical_name), -id))) AS best_name
        FROM parsed WHERE match_category IS NOT NULL GROUP BY match_category, brand, model, variant, cpu, storage, ram, size, resolution, refresh, panel, color HAVING count(*) > 1"""),
    "merged_wishes": (("products", "wishlist"), f"""WITH {PARSED}, s AS (
            SELECT id, min(id) OVER (PARTITION BY match_category, brand, model, variant, cpu, storage, ram, size, resolution, refresh, panel, color) AS survivor FROM parsed WHERE match_category IS NOT NULL),
        w AS (SELECT user_id, coalesce(s.survivor, product_id) AS product_id, user_id * 10000000 + wishlist.product_id AS id FROM wishlist LEFT JOIN s ON s.id = wishlist.product_id)
        SELECT user_id, product_id, min(id) AS id FROM w GROUP BY user_id, product_id"""),
    "reconcile_delist": (("stores", "listings"), f"WITH {DELIST} SELECT alias_id, action, delisted_at FROM done"),
    "delist_valve": (("stores", "listings"), f"WITH {DELIST} SELECT store_id, bool_or(refused) AS refused, count(*) FILTER (WHERE action = 'delist') AS delisted, count(*) FILTER (WHERE action = 'relist') AS relisted FROM done GROUP BY store_id"),
    "price_snapshot": (("listings", "prices"), f"""WITH {UPDATE}
        SELECT coalesce(s.alias_id, o.alias_id) AS alias_id, CAST(coalesce(s.price, o.price) AS {M}) AS price, coalesce(s.availability, o.availability) AS availability,
               CAST(coalesce(s.delivery_cost, o.delivery_cost) AS {M}) AS delivery_cost,
               CASE WHEN s.alias_id IS NOT NULL AND (o.alias_id IS NULL OR s.price <> o.price OR s.availability <> o.availability OR s.delivery_cost <> o.delivery_cost) THEN {NOW} ELSE o.recorded_at END AS last_updated,
               CASE WHEN s.alias_id IS NOT NULL THEN {NOW} ELSE o.recorded_at END AS checked_at
        FROM old o FULL JOIN seen s ON s.alias_id = o.alias_id"""),
    "price_changes": (("listings", "prices"), f"WITH {UPDATE} SELECT o.alias_id, CAST(o.price AS {M}) AS price, {NOW} AS recorded_at FROM old o JOIN seen s ON s.alias_id = o.alias_id WHERE s.price <> o.price"),
    "prune_guard": (("products", "wishlist", "price_alerts"), f"WITH {PARSED} SELECT id AS product_id FROM parsed WHERE category IS NULL INTERSECT (SELECT product_id FROM wishlist UNION SELECT product_id FROM price_alerts)"),
    "pruned_products": (("products", "wishlist", "price_alerts"), f"WITH {PARSED} SELECT id FROM parsed WHERE category IS NOT NULL OR id IN (SELECT product_id FROM wishlist UNION SELECT product_id FROM price_alerts)"),
    "prune_report": (("products",), f"WITH {PARSED} SELECT coalesce(match_category, '-') AS stored, count(*) AS n FROM parsed WHERE category IS NULL GROUP BY 1"),
    "orphan_products": (("products", "listings"), "SELECT id FROM products p WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.product_id = p.id)"),
    "listing_count_per_store": (("stores", "listings"), "SELECT id, name, (SELECT count(*) FROM listings l WHERE l.store_id = s.id) AS n FROM stores s"),
    "referenced_union": (("products", "wishlist", "price_alerts"), "SELECT product_id, count(*) AS n FROM (SELECT product_id FROM wishlist UNION ALL SELECT product_id FROM price_alerts) WHERE product_id IN (SELECT id FROM products) GROUP BY product_id"),
    "one_pending_run": ((), """SELECT id, CASE WHEN rn = 1 THEN status ELSE 'failed' END AS status FROM (
            SELECT *, row_number() OVER (ORDER BY status <> 'running', id DESC) AS rn FROM (
                SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status FROM orders) WHERE status <> 'done')"""),
    "parse_attributes": (("products",), f"WITH {PARSED} SELECT id, category, brand, model, variant, cpu, storage, ram, size, resolution, refresh, panel, color FROM parsed"),
    "score_tiers": (("stores", "listings", "products"), f"WITH {SCORED} SELECT query_id, product_id, tier, score, n_different FROM scored"),
    "tier_paging": (("stores", "listings", "products"), f"""WITH {SCORED}
        SELECT query_id, tier, CAST(place AS INT) AS place, product_id, tier_count, has_more FROM (
            SELECT *, max(tier_count) OVER (PARTITION BY query_id) > 8 AS has_more FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY lowest IS NULL, lowest, product_id) - 1 AS place, count(*) OVER (PARTITION BY query_id, tier) AS tier_count FROM scored))
        WHERE place >= 2 AND place < 8"""),
    "suggest": (("stores", "listings", "products"), f"""WITH {OFFERS}
        SELECT id, canonical_name FROM products p WHERE match_category IS NOT NULL AND (lower(canonical_name) LIKE '%iphone 1%' OR lower(canonical_name) LIKE '%ultra%') AND EXISTS (SELECT 1 FROM offers o WHERE o.product_id = p.id)
        ORDER BY length(canonical_name), id LIMIT 8"""),
    "type_ahead": (("stores", "listings", "products"), f"""WITH {OFFERS},
        terms(query_id, term) AS (VALUES (1, 'iphone 1'), (2, 'ultra'), (3, 'samsung ga'), (3, 'smasung ga'), (4, 'iphone'), (4, 'ايفو'), (5, 'no such'), (8, 'xps 1'), (8, 'xps-1'), (9, 'lg'), (10, '%')),
        found AS (SELECT DISTINCT t.query_id, p.id, p.canonical_name FROM terms t JOIN products p ON contains(lower(p.canonical_name), t.term) WHERE p.match_category IS NOT NULL AND p.id IN (SELECT product_id FROM offers))
        SELECT query_id, CAST(place AS INT) AS place, id, canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(canonical_name), id) AS place FROM found) WHERE place <= 8"""),
    "deep_page": (("stores", "listings", "products"), f"""WITH {SCORED}
        SELECT query_id, tier, CAST(place - 10 AS INT) AS place, product_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY lowest IS NULL, lowest, product_id) AS place FROM scored) WHERE place > 10 AND place <= 15"""),
    "rolling_taps": (("contact_events",), f"""WITH daily AS (SELECT store_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM contact_events GROUP BY ALL),
        days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
        taps AS (SELECT s.store_id, d.day, coalesce(n, 0) AS taps FROM (SELECT DISTINCT store_id FROM daily) s CROSS JOIN days d LEFT JOIN daily x ON x.store_id = s.store_id AND x.day = d.day)
        SELECT store_id, day, {', '.join(f"CAST(sum(taps) OVER (PARTITION BY store_id ORDER BY day RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS last_{n}" for n in (1, 7, 30, 365))} FROM taps"""),
    "committed_ingest": (("feed", "aliases"), f"""WITH {INGEST},
        told AS (SELECT alias_id, arg_max(price, store_product_id) AS price FROM landed WHERE alias_id IS NOT NULL GROUP BY alias_id),
        new AS (SELECT arg_max(price, store_product_id) AS price FROM landed WHERE alias_id IS NULL GROUP BY store_id, name)
        SELECT 'price' AS kind, p.alias_id, CAST(coalesce(t.price, p.price) AS {M}) AS price, CASE WHEN t.alias_id IS NULL THEN p.checked_at ELSE {NOW} END AS at FROM prices p LEFT JOIN told t ON t.alias_id = p.alias_id
        UNION ALL SELECT 'price', alias_id, CAST(price AS {M}), {NOW} FROM told WHERE alias_id NOT IN (SELECT alias_id FROM prices)
        UNION ALL SELECT 'price', NULL, CAST(price AS {M}), {NOW} FROM new
        UNION ALL SELECT 'history', p.alias_id, CAST(p.price AS {M}), {NOW} FROM prices p JOIN told t ON t.alias_id = p.alias_id WHERE t.price <> p.price"""),
    "query_meanings": ((), f"WITH {MEANT.strip()} SELECT query_id, normalized, corrected_query, category, brand, model, variant, storage, color FROM meant"),
    "search_answers": (("stores", "listings", "products"), f"WITH {ANSWERS} SELECT query_id, product_id, tier, score, n_different, corrected_query FROM answers"),
    "search_page": (("stores", "listings", "products"), f"""WITH {ANSWERS}
        SELECT query_id, tier, CAST(place AS INT) AS place, product_id, tier_count, has_more FROM (
            SELECT *, max(tier_count) OVER (PARTITION BY query_id) > 5 AS has_more FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY lower(canonical_name), product_id) - 1 AS place, count(*) OVER (PARTITION BY query_id, tier) AS tier_count FROM answers))
        WHERE place < 5"""),
    "feed_listings": (("feed",), f"""WITH {PARSED}
        SELECT concat('store', f.store_id) AS store, store_product_id, name, CAST(price AS {M}) AS price, availability, url, brand, image_url, p.category
        FROM (SELECT store_id, store_product_id, name, price, availability, url, brand, image_url, listed_product FROM feed) f JOIN (SELECT id, category FROM parsed) p ON p.id = f.listed_product WHERE p.category IS NOT NULL"""),
    "feed_slimmed": (("feed",), f"SELECT concat('store', store_id) AS store, count(*) AS listings, CAST(sum(price) AS {M}) AS prices FROM feed GROUP BY store_id"),
    "feed_completeness": (("feed",), """WITH n AS (SELECT store_id, count(*) AS n FROM feed GROUP BY store_id),
            r AS (SELECT *, CASE WHEN store_id % 7 = 5 THEN 'all: no empty page' WHEN store_id % 5 = 1 THEN 'all: HTTP 503' WHEN store_id % 5 = 2 THEN 'all: not valid JSON' WHEN store_id % 5 = 3 THEN 'all: no product list' END AS why FROM n)
        SELECT concat('store', store_id) AS store, why IS NULL AND n <= 400 AS complete, nullif(concat_ws('; ', why, CASE WHEN n > 400 THEN 'more than 400 kept listings' END), '') AS reason FROM r"""),
    "ingest_landed": (("feed", "aliases"), f"WITH {INGEST} SELECT store_id, store_product_id, match_method, ingest_brand, alias_id, product_id FROM landed"),
    "ingest_result": (("feed", "aliases"), f"""WITH {INGEST},
        counted AS (
            SELECT store_id, count(*) AS seen, CAST(0 AS BIGINT) AS failed, {', '.join(f"count(*) FILTER (WHERE match_method = '{m}') AS by_{m}" for m in ('sku', 'name', 'identity', 'canonical'))}, count(DISTINCT coalesce(CAST(alias_id AS VARCHAR), name)) AS aliases
            FROM landed GROUP BY store_id),
        told AS (SELECT alias_id, store_id, arg_max(price, store_product_id) AS price FROM landed WHERE alias_id IS NOT NULL GROUP BY alias_id, store_id),
        moved AS (SELECT t.store_id, count(*) AS price_changes FROM told t JOIN prices p ON p.alias_id = t.alias_id WHERE p.price <> t.price GROUP BY t.store_id),
        marked AS (
            SELECT a.*, a.alias_id IN (SELECT alias_id FROM told) OR EXISTS (SELECT 1 FROM feed f WHERE f.store_id = a.store_id AND f.store_product_id = a.store_product_id) AS here, a.store_id IN (SELECT store_id FROM counted) AS may FROM aliases a),
        gone AS (SELECT *, NOT here AND delisted_at IS NULL AND may AS gone, checked_at >= TIMESTAMP '1998-01-01 00:00:00' AS recent FROM marked),
        valve AS (SELECT store_id, count(*) FILTER (WHERE gone AND recent) > greatest(2, floor(count(*) FILTER (WHERE delisted_at IS NULL) * 0.25)) AS refused FROM gone GROUP BY store_id),
        done AS (SELECT g.store_id, any_value(v.refused) AS refused, count(*) FILTER (WHERE gone AND NOT (v.refused AND recent)) AS delisted, count(*) FILTER (WHERE here AND delisted_at IS NOT NULL) AS relisted FROM gone g JOIN valve v ON v.store_id = g.store_id GROUP BY g.store_id)
        SELECT c.*, coalesce(m.price_changes, 0) AS price_changes, coalesce(d.delisted, 0) AS delisted, coalesce(d.relisted, 0) AS relisted, coalesce(d.refused, false) AS refused
        FROM counted c LEFT JOIN moved m ON m.store_id = c.store_id LEFT JOIN done d ON d.store_id = c.store_id"""),
    "ingest_catalogue": (("feed", "aliases"), f"""WITH {INGEST},
        new AS (SELECT DISTINCT store_id, name FROM landed WHERE alias_id IS NULL), told AS (SELECT DISTINCT alias_id FROM landed WHERE alias_id IS NOT NULL),
        pictured AS (SELECT product_id, bool_or(picture IS NOT NULL) AS has FROM landed WHERE product_id IS NOT NULL GROUP BY product_id),
        made AS (SELECT identity, bool_or(picture IS NOT NULL) AS has FROM landed WHERE match_method = 'canonical' GROUP BY identity)
        SELECT 'aliases' AS entity, (SELECT count(*) FROM aliases) + (SELECT count(*) FROM new) AS n, (SELECT count(*) FROM told) + (SELECT count(*) FROM new) AS of_note
        UNION ALL SELECT 'products', (SELECT count(*) FROM known) + (SELECT count(*) FROM made),
            (SELECT count(*) FROM known k LEFT JOIN pictured p ON p.product_id = k.id WHERE k.image_url IS NOT NULL OR p.has) + (SELECT count(*) FROM made WHERE has)
        UNION ALL SELECT 'prices', (SELECT count(*) FROM prices) + (SELECT count(*) FROM new), (SELECT count(*) FROM told) + (SELECT count(*) FROM new)"""),
    "link_selection": (("stores", "listings"), f"""WITH {OFFERS}, u AS (SELECT store_id, concat('https://shop.example/products/p', product_id) AS url, count(*) AS listings FROM offers WHERE owner_user_id IS NULL GROUP BY ALL)
        SELECT store_id, url, listings FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY url) AS rn FROM u) WHERE rn <= 40"""),
    "spell_correct": (("products",), f"""WITH {SPELLING}
        SELECT t.id, coalesce(p.corrected, t.q) AS corrected, coalesce(told.corrections, concat(chr(123), chr(125))) AS corrections FROM typed t LEFT JOIN pieces p ON p.id = t.id LEFT JOIN told ON told.id = t.id"""),
    "arabic_normalize": (("products",), f"""WITH n AS (SELECT p.id, coalesce(k.plain, regexp_replace(replace(lower(canonical_name), '+', ' plus '), '[^a-z0-9_]', ' ', 'g')) AS n FROM products p LEFT JOIN {values('plain').replace('known(', 'k(')} ON k.golden = p.golden)
        SELECT id, regexp_replace(concat('iphone 15 ', n, ' black'), ' +', ' ', 'g') AS normalized FROM n"""),
    "link_prepare": ((), r"""WITH u AS (SELECT page_id % 5 AS store_id, concat(CASE WHEN page_id % 4 = 0 THEN 'http' ELSE 'https' END, '://shop.example', CASE WHEN page_id % 3 = 0 THEN '/pages/p' ELSE '/products/p' END, page_id) AS url FROM pages)
        SELECT DISTINCT store_id, url, nullif(regexp_extract(url, '^https?://[^/]+/products/([^/]+)/?$', 1), '') AS handle, regexp_matches(url, '^https://shop\.example/products/[^/]+/?$') AS well_formed FROM u"""),
    "link_audit": (("listings",), """WITH j AS (
            SELECT store_id, CASE WHEN alias_id % 11 = 0 THEN 'gone' WHEN alias_id % 13 = 0 THEN 'unknown' WHEN alias_id % 7 = 0 THEN 'variant_gone' WHEN alias_id % 17 = 0 THEN 'renamed' ELSE 'ok' END AS v FROM listings),
        c AS (SELECT store_id, count(*) FILTER (WHERE v = 'ok') AS ok, count(*) FILTER (WHERE v = 'renamed') AS renamed, count(*) FILTER (WHERE v = 'variant_gone') AS variant_gone,
                     count(*) FILTER (WHERE v = 'gone') AS gone, count(*) FILTER (WHERE v = 'unknown') AS unknown, count(*) AS checked FROM j GROUP BY store_id)
        SELECT *, gone + variant_gone > greatest(3, floor(checked * 0.2)) AS mass_removal FROM c"""),
    "offer_expiries": (("price_history",), f"""WITH w AS (
            SELECT alias_id, recorded_at AS t, lag(recorded_at) OVER (PARTITION BY alias_id ORDER BY recorded_at) AS p, lead(recorded_at) OVER (PARTITION BY alias_id ORDER BY recorded_at) AS n FROM price_history WHERE recorded_at <= {NOW})
        SELECT alias_id, 'new' AS event, t AS at FROM w WHERE p IS NULL UNION ALL SELECT alias_id, 'back', t FROM w WHERE t > p + INTERVAL 48 HOUR
        UNION ALL SELECT alias_id, 'gone', t + INTERVAL 48 HOUR FROM w WHERE (n IS NULL AND t + INTERVAL 48 HOUR < {NOW}) OR n > t + INTERVAL 48 HOUR"""),
    "feed_replay": (("landed",), """WITH r AS (SELECT store, CAST(max(page) + 1 AS INT) AS page, count(*) FILTER (WHERE status_code <> 200 OR NOT contains(text, '"id":')) AS ended FROM landed GROUP BY store)
        SELECT store, page, status_code FROM landed UNION ALL SELECT store, page, CAST(599 AS INT) FROM r WHERE ended = 0"""),
    "woocommerce_listings": (("feed",), f"""
        SELECT concat('store', store_id) AS store, CASE WHEN brand IS NULL THEN store_product_id ELSE concat('woo-', listed_alias) END AS store_product_id, concat(name, ' – new') AS name, CAST(price AS {M}) AS price, availability, url, image_url
        FROM feed WHERE image_url IS NOT NULL AND category IS NULL"""),
    "robots_allowed": (("stores", "listings"), """
        SELECT DISTINCT concat('store', store_id, '.example') AS host, concat('/products/p', product_id, CASE WHEN condition = 'used' THEN '?ref=1' ELSE '' END) AS path,
               (condition <> 'used' AND CAST(product_id AS VARCHAR) = concat(store_id, '7')) OR NOT (condition = 'used' OR starts_with(CAST(product_id AS VARCHAR), CAST(store_id AS VARCHAR))) AS allowed
        FROM listings"""),
    "sitemap_files": (("stores", "listings"), f"""WITH {OFFERS}
        SELECT concat('https://shop.example/product/', product_id) AS loc, strftime(max(checked_at), '%Y-%m-%dT%H:%M:%S+00:00') AS lastmod, true AS named FROM offers GROUP BY product_id HAVING bool_or(availability)"""),
    "answer_audit": (("listings",), f"SELECT alias_id, store_id, {VERDICT} AS verdict FROM listings"),
    "answer_audit_summary": (("listings",), f"""WITH v AS (SELECT store_id, lower({VERDICT}) AS v FROM listings),
        c AS (SELECT store_id, {', '.join(f"count(*) FILTER (WHERE v = '{v}') AS {v}" for v in ('ok', 'renamed', 'variant_gone', 'gone', 'unknown'))}, count(*) AS checked FROM v GROUP BY store_id)
        SELECT *, gone + variant_gone > greatest(3, floor(checked * 0.2)) AS mass_removal FROM c"""),
    "spell_arabic": (("products",), f"""WITH {ARABIC_SPELLING}
        SELECT p.id, concat(coalesce(fixed, w), ' ', regexp_replace(lower(canonical_name), '[^0-9]+', ' ', 'g')) AS corrected FROM products p JOIN typed t ON t.n = p.id % {len(MISTYPED)} LEFT JOIN fixes x ON x.n = t.n"""),
    "merged_listings": (("products", "listings"), f"WITH {PARSED}, {SURVIVORS} SELECT alias_id, coalesce(s.survivor, product_id) AS product_id FROM listings LEFT JOIN s ON s.id = product_id"),
    "merged_alerts": (("products", "price_alerts"), f"WITH {PARSED}, {SURVIVORS} SELECT min(a.id) AS id, user_id, coalesce(s.survivor, product_id) AS product_id FROM price_alerts a LEFT JOIN s ON s.id = product_id GROUP BY 2, 3"),
    "backfilled": (("products", "aliases"), f"""WITH {PARSED}, m AS (SELECT product_id, arg_max(store_product_name, (length(store_product_name), -alias_id)) AS better FROM aliases WHERE store_product_name <> lower(store_product_name) GROUP BY product_id)
        SELECT id, CASE WHEN image_url IS NULL OR canonical_name = lower(canonical_name) THEN coalesce(better, lower(canonical_name)) ELSE canonical_name END AS canonical_name, category AS match_category, brand, model
        FROM parsed LEFT JOIN m ON m.product_id = id WHERE category IS NOT NULL"""),
    "removed_products": (("products", "listings", "wishlist", "price_alerts", "contact_events"), """WITH kept AS (SELECT id FROM products WHERE id IN (SELECT product_id FROM listings WHERE delisted_at IS NULL)), doomed AS (SELECT id FROM products WHERE id NOT IN (SELECT id FROM kept))
        SELECT 'products' AS entity, count(*) AS n, count(*) AS named FROM kept
        UNION ALL SELECT 'wishlist', count(*), count(*) FROM wishlist WHERE product_id NOT IN (SELECT id FROM doomed) UNION ALL SELECT 'price_alerts', count(*), count(*) FROM price_alerts WHERE product_id NOT IN (SELECT id FROM doomed)
        UNION ALL SELECT 'contact_events', count(*), count(product_id) FILTER (WHERE product_id NOT IN (SELECT id FROM doomed)) FROM contact_events"""),
    "removed_account": (("users", "wishlist", "price_alerts", "stores"), """
        SELECT 'users' AS entity, count(*) AS n, count(*) AS showing, CAST(0 AS BIGINT) AS owned FROM users WHERE id <> 4 UNION ALL SELECT 'wishlist_items', count(*), count(*), 0 FROM wishlist WHERE user_id <> 4
        UNION ALL SELECT 'price_alerts', count(*), count(*), 0 FROM price_alerts WHERE user_id <> 4
        UNION ALL SELECT 'stores', count(*), count(*) FILTER (WHERE is_active = 1 AND owner_user_id IS DISTINCT FROM 4), count(owner_user_id) FILTER (WHERE owner_user_id <> 4) FROM stores"""),
    "cleanup": (("users", "stores", "listings", "wishlist", "price_alerts"), """WITH d AS (SELECT id FROM users WHERE NOT is_verified), gs AS (SELECT id FROM stores WHERE owner_user_id IN (SELECT id FROM d)),
        gp AS (SELECT product_id FROM listings GROUP BY product_id HAVING bool_and(store_id IN (SELECT id FROM gs)))
        SELECT 'store' AS kind, id FROM gs UNION ALL SELECT 'product', product_id FROM gp
        UNION ALL SELECT 'referring', count(*) FROM (SELECT user_id, product_id FROM wishlist UNION ALL SELECT user_id, product_id FROM price_alerts) WHERE user_id NOT IN (SELECT id FROM d) AND product_id IN (SELECT product_id FROM gp)
        UNION ALL SELECT 'refuse', CAST(count(*) = 0 AS BIGINT) FROM users WHERE role = 'admin' AND is_verified"""),
    "token_states": ((), f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS newest FROM orders)
        SELECT o_orderkey AS id, newest AND o_orderpriority NOT LIKE '1%' AND o_orderdate + INTERVAL 400 DAY > {FRESH} AS usable, newest AND o_orderdate <= {FRESH} - INTERVAL 2 MINUTE AS may_resend, o_orderdate + INTERVAL 400 DAY < {FRESH} - INTERVAL 30 DAY AS purge FROM t"""),
    "owner_edits": (("stores", "listings", "prices"), f"""
        SELECT p.alias_id, CAST(p.price AS {M}) AS price, {NOW} AS recorded_at FROM prices p JOIN listings l ON l.alias_id = p.alias_id JOIN stores s ON s.id = l.store_id WHERE s.owner_user_id IS NOT NULL AND l.price <> p.price"""),
    "owner_listing_keys": (("products", "listings"), f"""WITH n AS (SELECT p.id, coalesce(k.plain, regexp_replace(replace(lower(canonical_name), '+', ' plus '), '[^a-z0-9_]', ' ', 'g')) AS n FROM products p LEFT JOIN {values('plain').replace('known(', 'k(')} ON k.golden = p.golden)
        SELECT alias_id, concat('merchant:', condition, ':', substr(sha1(trim(regexp_replace(n, ' +', ' ', 'g'))), 1, 16)) AS key FROM listings JOIN n ON n.id = product_id"""),
    "next_job": ((), f"SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'running' END AS status FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate <= {NOW} - INTERVAL 60 MINUTE) ORDER BY o_orderdate, o_orderkey LIMIT 1"),
    "rate_window": ((), "SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 3"),
    "resolve_listings": (("products", "prices"), f"""WITH {PARSED}
        SELECT f.id AS listing, (SELECT min(k.id) FROM parsed k WHERE EXISTS (SELECT 1 FROM prices r WHERE r.product_id = k.id) AND k.category = f.category AND k.brand IS NOT DISTINCT FROM f.brand AND k.model IS NOT DISTINCT FROM f.model
            AND k.variant IS NOT DISTINCT FROM f.variant AND k.cpu IS NOT DISTINCT FROM f.cpu AND k.storage IS NOT DISTINCT FROM f.storage AND k.ram IS NOT DISTINCT FROM f.ram
            AND k.size IS NOT DISTINCT FROM f.size AND k.resolution IS NOT DISTINCT FROM f.resolution AND k.refresh IS NOT DISTINCT FROM f.refresh AND k.panel IS NOT DISTINCT FROM f.panel
            AND k.color IS NOT DISTINCT FROM f.color) AS resolved_product
        FROM parsed f"""),
    "sign_ins": (("sign_ins", "identities", "users"), """WITH r AS (SELECT *, CASE WHEN email_verified THEN nullif(lower(trim(email)), '') END AS address FROM sign_ins),
        l AS (SELECT r.*, i.user_id AS known, first_value(r.address IGNORE NULLS) OVER w AS account, count(r.address) OVER w AS vouched FROM r LEFT JOIN identities i ON i.provider = r.provider AND i.provider_subject = r.provider_subject
              WINDOW w AS (PARTITION BY r.provider, r.provider_subject ORDER BY r."at", r.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        f AS (SELECT id, row_number() OVER (PARTITION BY account ORDER BY l."at", id) AS nth FROM l WHERE known IS NULL AND vouched = 1 AND address IS NOT NULL),
        u AS (SELECT lower(email) AS account, min(id) AS user_id FROM users GROUP BY 1),
        o AS (SELECT l.id, CASE WHEN known IS NOT NULL THEN 'known' WHEN vouched = 0 THEN 'refused' WHEN f.id IS NULL THEN 'known' WHEN u.user_id IS NULL AND nth = 1 THEN 'created' ELSE 'linked' END AS action, coalesce(known, u.user_id) AS user_id, l.account
              FROM l LEFT JOIN f ON f.id = l.id LEFT JOIN u ON u.account = l.account)
        SELECT id, action, CASE WHEN action <> 'refused' THEN user_id END AS user_id, CASE WHEN action <> 'refused' AND user_id IS NULL THEN account END AS account FROM o"""),
    "name_clashes": (("applied", "stores"), "SELECT id, name FROM applied WHERE lower(name) IN (SELECT lower(name) FROM stores)"),
    "support_inbox": (("support", "users"), "SELECT s.id, s.user_id, u.role, s.created_at, (SELECT count(*) FROM support WHERE NOT handled) AS unhandled FROM support s LEFT JOIN users u ON u.id = s.user_id WHERE NOT handled ORDER BY s.created_at DESC, s.id DESC LIMIT 50"),
    "product_photos": (("photos", "listings", "stores"), """WITH p AS (SELECT l.product_id, l.store_id, f.* FROM photos f JOIN listings l ON l.alias_id = f.alias_id)
        SELECT product_id, arg_min(id, (uploaded_at, id)) AS id, arg_min(alias_id, (uploaded_at, id)) AS alias_id, min(uploaded_at) AS uploaded_at FROM p
        WHERE product_id IN (SELECT product_id FROM p JOIN stores s ON s.id = p.store_id WHERE s.is_active = 1 AND (s.owner_user_id IS NULL OR s.is_verified)) GROUP BY product_id"""),
    "photos_left": (("photos", "listings"), "SELECT store_id, count(*) AS photos, max(uploaded_at) AS newest FROM photos f JOIN listings l ON l.alias_id = f.alias_id WHERE store_id <> 4 GROUP BY store_id"),
    "registered_feeds": (("feed",), f"""
        SELECT concat('store', store_id) AS store, CASE WHEN store_id % 2 = 0 THEN 'shopify' ELSE 'woocommerce' END AS feed, CASE WHEN store_id % 2 = 0 OR brand IS NULL THEN store_product_id ELSE concat('woo-', listed_alias) END AS store_product_id, CAST(price AS {M}) AS price, availability
        FROM feed WHERE store_id % 3 <> 2 AND (store_id % 2 = 0 OR (image_url IS NOT NULL AND category IS NULL))"""),
    "hinted_categories": (("products",), f"""WITH {PARSED}
        SELECT id, CASE id % 5 WHEN 0 THEN CASE match_category WHEN 'phones' THEN 'Smart Phones 2024' WHEN 'laptops' THEN 'Gaming Laptops' WHEN 'monitors' THEN 'Monitor 27' END WHEN 1 THEN 'Laptop Sleeves' WHEN 2 THEN 'Uncategorized' WHEN 3 THEN '  ' END AS label,
               CASE WHEN id % 5 <> 1 THEN category END AS category, CASE WHEN id % 5 <> 1 THEN brand END AS brand FROM parsed"""),
    "described_matches": (("stores", "listings", "products"), f"""WITH {SCORED}
        SELECT s.query_id, s.product_id, concat_ws('; ', {DIFFERS}) AS told, concat_ws(' · ', p.model, nullif(p.variant, 'base'), {', '.join(f'p.{a}' for a in ATTRIBUTES[3:])}) AS attributes
        FROM scored s JOIN asked q ON q.query_id = s.query_id JOIN parsed p ON p.id = s.product_id"""),
    "contact_details": (("stores",), "SELECT id, CASE WHEN id % 6 < 4 THEN concat('07', lpad(CAST(id AS VARCHAR), 8, '0')) END AS phone, CASE WHEN id % 4 = 0 THEN concat('https://www.facebook.com/shop', id) END AS page FROM stores"),
    "price_labels": (("listings",), f"SELECT alias_id, printf('%.2f JOD', CAST(price AS DOUBLE)) AS label, CAST(floor((epoch({NOW}) - epoch(checked_at)) / 86400) AS BIGINT) AS age_days, strftime(checked_at, '%Y%m%dT%H%M%SZ') AS stamp FROM listings"),
    "text_digests": (("products",), f"""WITH {PARSED}
        SELECT id, sha256(canonical_name) AS fingerprint, url_encode(canonical_name) AS quoted, canonical_name AS unquoted, replace(replace(replace(replace(replace(canonical_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS escaped,
               sha256({OUTER} || unhex(sha256({INNER} || encode(canonical_name)))) AS pseudonym, storage FROM parsed"""),
    "guarded_changes": (("listings",), f"SELECT alias_id, {VERDICT} AS verdict, alias_id % 7 <> 0 AND delisted_at IS NULL AS applied FROM listings WHERE {VERDICT} IN ('GONE', 'VARIANT_GONE', 'RENAMED')"),
    "run_verdicts": (("feed", "listings", "stores"), f"WITH {VERDICTS} SELECT store_id, seen, failed, verdict FROM verdicts"),
    "job_result": (("feed", "listings", "stores"), f"WITH {VERDICTS} SELECT bool_and(verdict <> 'ok') AS failed, count(*) FILTER (WHERE verdict <> 'ok') AS failures, count(*) AS stores, count(*) FILTER (WHERE verdict <> 'ok') = 0 AS send_alerts FROM verdicts"),
    "run_due": ((), "SELECT CAST(h AS INT) AS hours, max(o_orderdate) <= TIMESTAMP '2000-01-01 00:00:00' - to_hours(h) AS due FROM orders, (VALUES (6), (8760), (876000)) v(h) WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%' GROUP BY h"),
}
