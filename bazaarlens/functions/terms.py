"""Vocabulary of product titles: brands, colours, category words, patterns, Arabic terms."""

from __future__ import annotations

# They decide which titles parse to what.

BRAND_WORDS = (
    "apple", "samsung", "sony", "lg", "huawei", "xiaomi", "nokia", "oppo", "realme", "google", "dell", "hp", "lenovo", "asus", "acer", "msi",
    "honor", "vivo", "infinix", "tecno", "motorola", "tcl", "doogee", "microsoft",
)
BRAND_LINES = {
    "iphone": "apple", "ipad": "apple", "macbook": "apple", "airpods": "apple", "imac": "apple", "watch": "apple",
    "galaxy": "samsung", "note": "samsung", "redmi": "xiaomi", "poco": "xiaomi", "mi": "xiaomi",
    "playstation": "sony", "ps5": "sony", "ps4": "sony", "bravia": "sony", "pixel": "google",
    "thinkpad": "lenovo", "ideapad": "lenovo", "inspiron": "dell", "xps": "dell", "latitude": "dell",
    "pavilion": "hp", "elitebook": "hp", "omen": "hp", "zenbook": "asus", "vivobook": "asus", "rog": "asus",
    "nova": "huawei", "mate": "huawei", "moto": "motorola", "razr": "motorola", "surface": "microsoft",
}
COLOUR_WORDS = (
    "midnight green", "space gray", "sierra blue", "pacific blue", "phantom black", "natural titanium", "blue titanium", "alpine green",
    "deep purple", "rose gold", "sky blue", "starlight", "graphite", "midnight", "titanium", "lavender", "black", "white", "silver",
    "gold", "blue", "red", "green", "purple", "pink", "yellow", "orange", "gray", "cream", "mint", "beige",
)
COLOUR_NAMES = {"grey": "gray", "space grey": "space gray", "jet black": "black", "matte black": "black", "midnight": "black"}

NEVER = ("tv", "television", "televisions", "all in one", "desktop")
PLACEHOLDER_HINTS = ("uncategorized", "uncategorised", "unknown", "n/a")

PHONE_WORDS = ("iphone", "galaxy", "redmi", "poco", "pixel", "smartphone", "phone", "nova", "mate", "mobile")
PHONE_BRANDS = ("oppo", "realme", "nokia", "honor", "xiaomi", "samsung", "vivo", "infinix", "tecno", "huawei", "motorola", "moto", "doogee", "tcl")
PHONE_VARIANTS = ("pro plus", "pro max", "pro", "plus", "ultra", "mini", "fe", "max")
PHONE_MODELS = (
    r"\b(iphone)\s*(\d{1,2})",
    r"\b(galaxy)\s+(note|[sazmfj])\s*(\d{1,3})",
    r"\b(redmi\s+note)\s*(\d{1,3}[a-z]?)\b",
    r"\b(redmi|poco|pixel|nova|mate)\s*([a-z]?\d{1,3}[a-z]?)\b",
    r"\b(spark|camon|pova|phantom|reno|blade|edge|narzo|nord|razr)\s*(\d{1,3}[a-z]?)\b",
    r"\b(honor|samsung|xiaomi|realme|oppo|vivo|infinix|tecno|motorola|doogee|tcl)\b"
    r"(?:\s+(?:smart|smartphones?|mobile|phones?)){0,3}\s+((?!\d+[gk]\b)(?:[a-z]{1,2}\d{1,4}[a-z]?|\d{1,4}[a-z]))\b",
)

LAPTOP_WORDS = (
    "macbook", "laptop", "notebook", "thinkpad", "ideapad", "inspiron", "xps", "pavilion", "elitebook", "zenbook", "vivobook", "omen", "rog", "book", "surface",
)
LAPTOP_BRANDS = ("dell", "hp", "lenovo", "asus", "acer", "msi", "microsoft")
LAPTOP_VARIANTS = ("air", "pro", "plus", "max")
LAPTOP_MODELS = (
    r"\b(macbook)\b",
    r"\b(thinkpad|ideapad|inspiron|xps|pavilion|elitebook|zenbook|vivobook|omen|rog|surface)\s*(\w{1,6})?",
)
PROCESSORS = (
    r"\b(m\d{1,2})\b",
    r"\b(i[3579])(?:[- ]?\d{4,5}[a-z]{0,2})?\b",
    r"\b(?:core\s+)?(ultra)\s*(\d)\b",
    r"\b(core)\s+(\d)[- ]?\d{3,4}[a-z]{0,2}\b",
    r"\b(celeron|pentium|athlon)\b",
    r"\b(ryzen)\s*(?:ai\s*)?(\d)\d*[a-z]*",
    r"\b(a\d{2})\b",
)

MONITOR_WORDS = ("monitor",)
SCREEN_SIZES = (
    r"\b(1[7-9]|[2-9]\d)\s*inch\b",
    r"\b(1[7-9]|[2-5]\d)\b(?!\s*(?:hz|gb|tb|mm|ms|w|k)\b)(?:\s(\d)\b)?",
)
RESOLUTION_WORDS = ("8k", "5k", "4k", "2k", "fhd", "hd")
RESOLUTION_NAMES = {"uhd": "4k", "2160p": "4k", "qhd": "2k", "wqhd": "2k", "dqhd": "2k", "1440p": "2k", "full hd": "fhd", "1080p": "fhd"}
REFRESH_RATES = (r"\b(\d{2,3})\s*hz\b",)
PANEL_WORDS = ("qd-oled", "oled", "nano ips", "ips", "va", "tn")
PANEL_NAMES = {"quantum dot oled": "qd-oled"}

CAPACITY = r"(\d+)\s*(gb|tb)\b"

# Arabic letters that are typed for one another, marks that carry no identity, digits of both kinds.
ARABIC_FROM, ARABIC_TO = "أإآٱةىؤئگچپڤ", "ااااهيويكجبف"
ARABIC_MARKS = "[ً-ٰٕـ]"
ARABIC_DIGITS = "".join(chr(base + d) for base in (0x0660, 0x06F0) for d in range(10))
ARTICLE = "ال"

# Folded Arabic terms and the word that each stands for.
ARABIC_TERMS = {
    "جوال": "phone", "جوالات": "phone", "موبايل": "phone", "موبايلات": "phone", "هاتف": "phone", "هواتف": "phone", "تلفون": "phone",
    "ايفون": "iphone", "لابتوب": "laptop", "لاب توب": "laptop", "حاسوب": "laptop", "كمبيوتر": "laptop", "نوت بوك": "notebook",
    "شاشه": "monitor", "شاشات": "monitor", "مونيتور": "monitor", "تلفزيون": "tv", "تليفزيون": "tv", "تلفاز": "tv",
    "ابل": "apple", "ايباد": "ipad", "ماك بوك": "macbook", "ماكبوك": "macbook", "سامسونج": "samsung", "سامسونغ": "samsung",
    "جالاكسي": "galaxy", "غالاكسي": "galaxy", "شاومي": "xiaomi", "شياومي": "xiaomi", "ريدمي": "redmi", "بوكو": "poco",
    "هواوي": "huawei", "نوكيا": "nokia", "اوبو": "oppo", "ريلمي": "realme", "هونر": "honor", "فيفو": "vivo", "انفينكس": "infinix",
    "تكنو": "tecno", "موتورولا": "motorola", "دوجي": "doogee", "جوجل": "google", "غوغل": "google", "بكسل": "pixel", "سوني": "sony",
    "ال جي": "lg", "ديل": "dell", "لينوفو": "lenovo", "اسوس": "asus", "ايسر": "acer", "مايكروسوفت": "microsoft", "هونداي": "hyundai",
    "برو": "pro", "ماكس": "max", "بلس": "plus", "بلاس": "plus", "الترا": "ultra", "ميني": "mini", "اير": "air", "ايه": "air",
    "اسود": "black", "ابيض": "white", "ازرق": "blue", "احمر": "red", "اخضر": "green", "اصفر": "yellow", "ذهبي": "gold", "فضي": "silver",
    "رمادي": "gray", "رصاصي": "gray", "وردي": "pink", "زهري": "pink", "بنفسجي": "purple", "برتقالي": "orange", "بيج": "beige", "نحاسي": "bronze",
    "جيجا": "gb", "جيجابايت": "gb", "غيغا": "gb", "غيغابايت": "gb", "جيغا": "gb", "تيرا": "tb", "تيرابايت": "tb", "رام": "ram", "ذاكره": "ram",
    "تخزين": "storage", "بوصه": "inch", "انش": "inch", "هرتز": "hz", "بطاريه": "battery", "جديد": "new", "مستعمل": "used",
}
