"""Results depend on these words, codes and thresholds exactly as they stand."""

from __future__ import annotations

# Merchant category codes.
MCC = {
    "4812": "telecom", "4813": "telecom", "4814": "telecom", "4816": "software", "4899": "streaming", "4900": "utilities",
    "5045": "software", "5065": "software", "5734": "software", "5945": "gaming", "7372": "software", "7375": "software",
    "7399": "software", "7922": "streaming", "7994": "gaming", "7995": "gaming", "8011": "insurance", "8049": "insurance",
    "6300": "insurance", "6321": "insurance",
}

# Category of a normalized name.  Six of the spellings can never be produced by the normalizer; they are data.
NAME_CATEGORY = {
    "Netflix": "streaming", "Hulu": "streaming", "Disney+": "streaming", "Max": "streaming", "Peacock": "streaming",
    "Paramount+": "streaming", "YouTube": "streaming", "Twitch": "streaming", "Spotify": "music", "Pandora": "music",
    "Audible": "music", "Adobe": "software", "Canva": "software", "GitHub": "software", "Notion": "software",
    "Slack": "software", "Zoom": "software", "Microsoft": "software", "Kindle": "software", "Duolingo": "software",
    "Calm": "software", "Headspace": "software", "Icloud+": "cloud_storage", "Icloud": "cloud_storage", "Apple": "app_store",
    "Google": "app_store", "Amazon": "mixed_commerce", "Xbox": "gaming", "PlayStation": "gaming", "Nintendo": "gaming",
    "NY Times": "news", "Wall Street Journal": "news", "Washington Post": "news", "Dropbox": "cloud_storage",
    "Verizon": "telecom", "At&T": "telecom", "T-Mobile": "telecom", "Sprint": "telecom", "Comcast": "telecom",
    "Xfinity": "telecom", "Spectrum": "telecom", "Cox": "telecom", "Pg&E": "utilities", "Con Edison": "utilities",
    "Duke Energy": "utilities", "Sce": "utilities", "Dominion": "utilities", "Geico": "insurance", "State Farm": "insurance",
    "Allstate": "insurance", "Progressive": "insurance", "Aetna": "insurance", "Cigna": "insurance", "Peloton": "fitness",
    "Planet Fitness": "fitness", "Doordash": "delivery", "Instacart": "delivery",
}

# Keyword patterns on the raw name; the first that is found decides.
KEYWORDS = [
    (r"stream|video|watch|movies?|tv\b", "streaming"),
    (r"music|audio|podcast|radio|sound", "music"),
    (r"cloud|storage|backup|drive|sync", "cloud_storage"),
    (r"software|saas|license|subscription|pro\b|premium", "software"),
    (r"game|gaming|xbox|playstation|steam|nintendo", "gaming"),
    (r"wireless|cellular|mobile|phone|telecom|internet|broadband|cable", "telecom"),
    (r"electric|gas|water|power|energy|utility|utilities|autopay", "utilities"),
    (r"insurance|insur|policy|premium|coverage|geico|allstate", "insurance"),
    (r"news|magazine|journal|times|post|press|media", "news"),
    (r"gym|fitness|workout|yoga|health|wellness", "fitness"),
    (r"delivery|groceries|meal|food.*kit", "delivery"),
    (r"app\.?com|app.*bill|itunes|google.*play|play.*store", "app_store"),
]

# Category, least difference, least relative change, lookback, seasonal, split tiers, extra checks.
RULES = [
    ("streaming", 3.0, 0.15, 6, False, False, []),
    ("music", 2.0, 0.15, 6, False, False, []),
    ("software", 5.0, 0.10, 6, False, False, ["duplicate_charge", "annual_conversion"]),
    ("cloud_storage", 3.0, 0.15, 6, False, False, []),
    ("gaming", 3.0, 0.15, 6, False, False, []),
    ("news", 2.0, 0.20, 6, False, False, []),
    ("fitness", 5.0, 0.15, 6, False, False, []),
    ("telecom", 15.0, 0.25, 3, False, False, ["roaming", "late_fee", "device_installment"]),
    ("utilities", 20.0, 0.30, 6, True, False, ["seasonal_spike"]),
    ("insurance", 10.0, 0.15, 6, False, False, ["annual_renewal"]),
    ("app_store", 3.0, 0.20, 6, False, True, []),
    ("mixed_commerce", 5.0, 0.20, 6, False, True, ["non_subscription_charge"]),
    ("delivery", 5.0, 0.20, 4, False, False, ["non_subscription_charge"]),
    ("general", 5.0, 0.20, 6, False, False, []),
]
#: Categories in the order of their index as a feature.
CATEGORIES = ["streaming", "music", "software", "cloud_storage", "gaming", "news", "fitness", "telecom", "utilities", "insurance", "app_store", "mixed_commerce", "delivery", "general"]

# Reasons by category, for the others, and by extra check.
CATEGORY_REASONS = {
    "telecom": ["Roaming charges", "New device installment", "Plan add-on", "Late fee"],
    "utilities": ["Seasonal usage spike", "Rate increase", "Usage overage"],
    "insurance": ["Annual premium adjustment", "Coverage change", "Rate increase"],
    "software": ["Seat count change", "Annual plan conversion", "Add-on feature"],
    "app_store": ["New in-app subscription", "Plan upgrade", "Price increase"],
    "mixed_commerce": ["New subscription added", "Membership fee change"],
}
OTHER_REASONS = ["Plan upgrade", "Expired promotional discount", "Annual renewal", "Added feature or add-on", "Billing error"]
DOUBLED_REASON = "Possible unauthorized charge"
CHECK_REASONS = {
    "annual_conversion": "Monthly-to-annual plan conversion",
    "duplicate_charge": "Possible duplicate charge",
    "roaming": "International roaming",
    "late_fee": "Late payment fee",
    "device_installment": "New device installment added",
    "seasonal_spike": "Seasonal usage increase",
    "annual_renewal": "Annual renewal",
    "non_subscription_charge": "One-time purchase mixed with subscription",
}

# Billing cycles (label, least and most days between charges, nominal days).
CYCLES = [("weekly", 5, 9, 7), ("biweekly", 12, 16, 14), ("monthly", 28, 35, 30), ("quarterly", 85, 95, 91), ("annual", 350, 380, 365)]
#: Severity from a score.
SEVERITIES = [(0.85, "high"), (0.65, "warning"), (0.40, "low")]
#: Without a category's thresholds: expected below, least difference, least relative change.
UNIVERSAL = [(20.0, 3.0, 0.20), (100.0, 10.0, 0.15), (float("inf"), 25.0, 0.10)]

# The services a new registry holds (name, category, aliases).
SEEDS = [
    ("Netflix", "streaming", ["netflix", "nflx", "netflix com"]),
    ("Spotify", "music", ["spotify", "spotify usa", "spotify premium"]),
    ("Apple", "app_store", ["apple", "apple com bill", "itunes"]),
    ("Amazon", "mixed_commerce", ["amazon", "amzn", "amazon prime"]),
    ("Adobe", "software", ["adobe", "adobe creative", "adobe creative cloud"]),
    ("Google", "app_store", ["google", "google play"]),
    ("YouTube", "streaming", ["youtube", "youtube premium"]),
    ("Hulu", "streaming", ["hulu"]),
    ("Disney+", "streaming", ["disney", "disneyplus", "disney plus"]),
    ("Max", "streaming", ["max", "hbomax", "hbo max"]),
    ("Paramount+", "streaming", ["paramount", "paramount plus"]),
    ("Peacock", "streaming", ["peacock"]),
    ("Canva", "software", ["canva"]),
    ("iCloud+", "cloud_storage", ["icloud", "icloud+", "icloud plus"]),
    ("Dropbox", "cloud_storage", ["dropbox"]),
    ("GitHub", "software", ["github"]),
    ("Notion", "software", ["notion"]),
    ("Microsoft", "software", ["microsoft", "office365", "office 365"]),
    ("Zoom", "software", ["zoom"]),
    ("Audible", "music", ["audible"]),
    ("Twitch", "streaming", ["twitch"]),
    ("PG&E", "utilities", ["pg&e", "pg e", "pge", "pacific gas electric", "pg&e autopay"]),
    ("AT&T", "telecom", ["at&t", "att", "at t", "at&t wireless"]),
    ("Verizon", "telecom", ["verizon", "verizon wireless", "vzw"]),
    ("T-Mobile", "telecom", ["t-mobile", "tmobile", "t mobile"]),
    ("Comcast", "telecom", ["comcast", "xfinity"]),
    ("Geico", "insurance", ["geico", "geico insurance"]),
    ("State Farm", "insurance", ["state farm"]),
]

# Input headers (lower case, with underscores) and the fields they stand for.
HEADERS = {
    "transaction_id": "transaction_id", "id": "transaction_id", "txn_id": "transaction_id",
    "merchant_raw": "merchant_raw", "merchant": "merchant_raw", "description": "merchant_raw", "payee": "merchant_raw", "name": "merchant_raw",
    "amount": "amount", "value": "amount", "charge": "amount",
    "date": "date", "txn_date": "date", "transaction_date": "date", "posted_date": "date",
    "category_mcc": "category_mcc", "mcc": "category_mcc", "currency": "currency", "payment_method": "payment_method",
    "note": "description", "memo": "description",
}
# Date formats in the order in which they are tried.
DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy", "yyyyMMdd"]

# What is taken out of a raw name, one pattern after the other, each for one space.
STRIP = [
    r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
    r"\b\d{5,}\b",
    r"\b[A-Z]{2}\b(?=\s|$)",
    r"#\S+",
    r"\*+\S*",
    r"\b(llc|inc|corp|ltd|co)\b",
    r"[^\w\s.&+/-]",
]
DOMAIN_ENDINGS = r"\.(com|net|org|io|co|biz|app)\b"
