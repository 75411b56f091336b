"""Product titles of shops in all their kinds, and what each must parse to as a listing.

The rows are fixed values, written down from the rules and not made by them: queries read the
titles, and their SQL the rest.
"""

from __future__ import annotations

COLUMNS = ("title", "category", "brand", "model", "variant", "cpu", "storage", "ram", "size", "resolution", "refresh", "panel", "color", "plain")


def _phone(title: str, brand: str, model: str, variant: str = "base", storage: str | None = None, ram: str | None = None, color: str | None = None, plain: str | None = None) -> tuple:
    return (title, "phones", brand, model, variant, None, storage, ram, None, None, None, None, color, plain)


def _laptop(title: str, brand: str, model: str | None = None, variant: str | None = None, cpu: str | None = None, storage: str | None = None, ram: str | None = None, color: str | None = None, plain: str | None = None) -> tuple:
    return (title, "laptops", brand, model, variant, cpu, storage, ram, None, None, None, None, color, plain)


def _monitor(title: str, brand: str | None, size: str, resolution: str | None, refresh: str | None, panel: str | None = None, color: str | None = None, plain: str | None = None) -> tuple:
    return (title, "monitors", brand, None, None, None, None, None, size, resolution, refresh, panel, color, plain)


def _nothing(title: str, plain: str | None = None) -> tuple:
    return (title, *[None] * 12, plain)


#: ``plain``: the normalised form of a title in Arabic.
TITLES = (
    _phone("Samsung Galaxy S24 128GB Black", "samsung", "galaxy s 24", storage="128gb", color="black"),
    _phone("Samsung Galaxy Note 20 256GB Phantom Black", "samsung", "galaxy note 20", storage="256gb", color="phantom black"),
    _phone("Redmi Note 15 Pro+ 5G", "xiaomi", "redmi note 15", "pro plus"),
    _phone("Xiaomi Redmi Note 15 Pro+ 5G, 12GB & 512GB, 6.8Inch, Black", "xiaomi", "redmi note 15", "pro plus", "512gb", "12gb", "black"),
    _phone("Redmi Note 15 Pro 5G 128GB Black", "xiaomi", "redmi note 15", "pro", "128gb", color="black"),
    _phone("Oppo Smart Phones Reno12 F 4G 256GB", "oppo", "reno 12", storage="256gb"),
    _phone("TECNO SPARK 50 128GB Blue", "tecno", "spark 50", storage="128gb", color="blue"),
    _phone("Samsung A26 8GB 256GB - Black", "samsung", "samsung a26", storage="256gb", ram="8gb", color="black"),
    _phone("Honor X5c Plus 64GB Midnight Black", "honor", "honor x5c", "plus", "64gb", color="black"),
    _phone("Google Pixel 8a 128GB", "google", "pixel 8a", storage="128gb"),
    _phone("Huawei Nova 12i 256GB Alpine Green", "huawei", "nova 12i", storage="256gb", color="alpine green"),
    _phone("Motorola Razr 50 Ultra 512GB", "motorola", "razr 50", "ultra", "512gb"),
    _phone("Poco X6 Pro 12GB 512GB Yellow", "xiaomi", "poco x6", "pro", "512gb", "12gb", "yellow"),
    _phone("iPhone 15 Pro 1TB Natural Titanium", "apple", "iphone 15", "pro", "1024gb", color="natural titanium"),
    _phone("iPhone 13 mini 128GB Starlight", "apple", "iphone 13", "mini", "128gb", color="starlight"),
    _phone("Samsung Galaxy S23 FE 256GB Mint", "samsung", "galaxy s 23", "fe", "256gb", color="mint"),
    _phone("ايفون ١٥ ١٢٨ جيجا اسود", "apple", "iphone 15", storage="128gb", color="black", plain="iphone 15 128 gb black"),
    _phone("ايفون ١٥ برو ماكس ٢٥٦ جيجا", "apple", "iphone 15", "pro max", "256gb", plain="iphone 15 pro max 256 gb"),
    _phone("جوال سامسونج جالاكسي A54 128 جيجا", "samsung", "galaxy a 54", storage="128gb", plain="phone samsung galaxy a54 128 gb"),
    _laptop("MacBook Pro M3 16GB RAM 512GB SSD Space Grey", "apple", "macbook", "pro", "m3", "512gb", "16gb", "space gray"),
    _laptop("ASUS Vivobook Pro 14 OLED M3401QA AMD RYZEN 5800H 512GB", "asus", "vivobook pro", "pro", "ryzen 5", "512gb"),
    _laptop("HP 15-fd2104TU Intel Core Ultra 5 225U 512GB", "hp", cpu="ultra 5", storage="512gb"),
    _laptop("HP ProBook Intel Core 5-120U 16GB 512GB SSD", "hp", cpu="core 5", storage="512gb", ram="16gb"),
    _laptop("ASUS TUF Gaming A16 AMD Ryzen 7 260 16GB 512GB", "asus", cpu="ryzen 7", storage="512gb", ram="16gb"),
    _laptop("Microsoft Surface Pro 11 (2025) Intel Core Ultra 7 266V 512GB 16GB", "microsoft", "surface pro", "pro", "ultra 7", "512gb", "16gb"),
    _laptop("Lenovo ThinkPad X1 Intel i7-1355U 16GB 1TB Black", "lenovo", "thinkpad x1", cpu="i7", storage="1024gb", ram="16gb", color="black"),
    _laptop("Acer Aspire Intel Celeron 128GB 4GB", "acer", cpu="celeron", storage="128gb", ram="4gb"),
    _laptop("لابتوب ماك بوك اير ٢٥٦ جيجا", "apple", "macbook", "air", storage="256gb", plain="laptop macbook air 256 gb"),
    _monitor('MSI G255F 24.5" FHD 180Hz IPS Monitor', "msi", "24 5", "fhd", "180", "ips"),
    _monitor('ASUS TUF Gaming VG27WQ 27" Curved 2K HDR 165Hz GAMING MONITOR', "asus", "27", "2k", "165"),
    _monitor('Dell SE2725HM Flat Monitor 27" FHD IPS @100HZ', "dell", "27", "fhd", "100", "ips"),
    _monitor("Samsung Odyssey 32 inch UHD QD-OLED Monitor 240Hz White", "samsung", "32", "4k", "240", "oled", "white"),
    _monitor("شاشة ٢٧ بوصة 2k ١٨٠ هرتز", None, "27", "2k", "180", plain="monitor 27 inch 2k 180 hz"),
    _nothing("Philips 24 Monitor"),
    _nothing("Samsung 55 inch 4K Smart TV"),
    _nothing("تلفزيون سامسونج 55 بوصة", plain="tv samsung 55 inch"),
    _nothing("HP All in One Desktop i5 512GB"),
    _nothing("Sony PlayStation 5 Slim Console"),
    _nothing("Philips 4-Slice Toaster"),
    _nothing("12345"),
    _nothing("%%%%"),
)


def values(*columns: str) -> str:
    """The numbered titles with the named columns, as the VALUES of a SQL table."""
    at = [COLUMNS.index(c) for c in columns]
    literal = lambda v: "CAST(NULL AS VARCHAR(80))" if v is None else f"'{v}'"  # noqa: E731  (no title has a quote)
    return "(VALUES " + ", ".join(f"({k}, {', '.join(literal(row[i]) for i in at)})" for k, row in enumerate(TITLES)) + f") AS known(golden, {', '.join(columns)})"
