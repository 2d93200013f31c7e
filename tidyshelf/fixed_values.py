"""Fixed values.

Word lists, lookup tables, patterns and message formats whose exact content
decides the results. They are kept together here as plain text; the rest of
the package refers to them by name.
"""

# Cells that count as missing when text is cleaned.
BLANK_WORDS = ["nan", "none", "null", "n/a", "na", "-"]

# Source values that are placeholders, not data.
PLACEHOLDER_WORDS = [
    "-- unbranded --", "-- no unilog brand --", "-- no dib brand --",
    "unbranded", "none", "null", "nan", "n/a", "na", "-", "--", "",
    "unknown", "not specified", "not provided", "tbd",
]

# Lower-case brand spelling -> canonical brand.
BRANDS = {
    "abb": "ABB", "siemens": "Siemens", "siemens simatic": "Siemens", "weg": "WEG",
    "baldor-reliance": "Baldor-Reliance", "baldor": "Baldor-Reliance", "nidec": "Nidec",
    "sew-eurodrive": "SEW-Eurodrive", "grundfos": "Grundfos", "ksb": "KSB",
    "flowserve": "Flowserve", "sulzer": "Sulzer", "wilo": "Wilo", "xylem": "Xylem",
    "emerson": "Emerson", "emerson fisher": "Emerson Fisher",
    "emerson rosemount": "Emerson Rosemount", "samson": "Samson", "bray": "Bray",
    "velan": "Velan", "kitz": "Kitz", "endress+hauser": "Endress+Hauser",
    "yokogawa": "Yokogawa", "ifm electronic": "IFM Electronic", "ifm": "IFM Electronic",
    "sick": "Sick", "honeywell": "Honeywell", "honeywell analytics": "Honeywell Analytics",
    "skf": "SKF", "nsk": "NSK", "fag": "FAG Schaeffler", "fag schaeffler": "FAG Schaeffler",
    "timken": "Timken", "ntn": "NTN", "koyo": "Koyo", "atlas copco": "Atlas Copco",
    "ingersoll rand": "Ingersoll Rand", "kaeser": "Kaeser", "sullair": "Sullair",
    "boge": "Boge", "gardner denver": "Gardner Denver",
    "rockwell": "Rockwell Allen-Bradley", "rockwell allen-bradley": "Rockwell Allen-Bradley",
    "allen-bradley": "Rockwell Allen-Bradley", "schneider": "Schneider Electric",
    "schneider electric": "Schneider Electric", "schneider galaxy": "Schneider Galaxy",
    "mitsubishi": "Mitsubishi Electric", "mitsubishi electric": "Mitsubishi Electric",
    "omron": "Omron", "eaton": "Eaton", "legrand": "Legrand", "chint": "Chint",
    "pilz": "Pilz", "euchner": "Euchner", "banner": "Banner Engineering",
    "banner engineering": "Banner Engineering", "pepperl+fuchs": "Pepperl+Fuchs",
    "caterpillar": "Caterpillar", "cummins": "Cummins", "vertiv": "Vertiv Liebert",
    "vertiv liebert": "Vertiv Liebert", "sma": "SMA Solar", "sma solar": "SMA Solar",
    "huawei": "Huawei Digital Power", "huawei digital power": "Huawei Digital Power",
}

# Brand patterns searched in free text, in order of priority.
BRAND_PATTERNS = [
    (r"\b(diablo)\b", "Diablo"),
    (r"\b(3m)\b", "3M"),
    (r"\b(abb)\b", "ABB"),
    (r"\b(siemens)\b", "Siemens"),
    (r"\b(schneider(?:\s+electric)?)\b", "Schneider Electric"),
    (r"\b(rockwell|allen[-\s]bradley)\b", "Rockwell Allen-Bradley"),
    (r"\b(eaton)\b", "Eaton"),
    (r"\b(sew[-\s]eurodrive)\b", "SEW-Eurodrive"),
    (r"\b(grundfos)\b", "Grundfos"),
    (r"\b(flowserve)\b", "Flowserve"),
    (r"\b(honeywell)\b", "Honeywell"),
    (r"\b(skf)\b", "SKF"),
    (r"\b(atlas\s+copco)\b", "Atlas Copco"),
    (r"\b(ingersoll\s+rand)\b", "Ingersoll Rand"),
    (r"\b(baldor(?:-reliance)?)\b", "Baldor-Reliance"),
    (r"\b(endress(?:\+|\s+and\s+)hauser)\b", "Endress+Hauser"),
    (r"\b(yokogawa)\b", "Yokogawa"),
    (r"\b(ifm(?:\s+electronic)?)\b", "IFM Electronic"),
    (r"\b(banner(?:\s+engineering)?)\b", "Banner Engineering"),
]

# Canonical field -> (label, type, header aliases), in match order.
CANONICAL_FIELDS = {
    "product_identifier": ("Product Identifier", "string", [
        "product_id", "id", "item_code", "product_code", "item_no", "item_id",
        "part_no", "part_num", "article_no", "code"]),
    "mpn": ("Manufacturer Part Number (MPN)", "string", [
        "mfg_part_num", "part_number", "partnumber", "mfr_part_no", "mfg_pn", "mpn",
        "pn", "part_no", "mfr_part_num"]),
    "sku": ("SKU", "string", [
        "sku", "stock_code", "inventory_id", "sku_number", "item_sku"]),
    "product_name": ("Product Name / Title", "string", [
        "product_name", "name", "title", "item_name", "product_title", "headline",
        "item_title", "part_name"]),
    "product_description": ("Product Description", "string", [
        "description", "desc", "part_desc", "longdescription", "long_desc", "details",
        "item_description", "product_desc", "summary"]),
    "brand": ("Brand Name", "string", [
        "brand", "brand_name", "brandname", "e1_brand", "unilog_brand", "dib_brand",
        "trade_brand", "label"]),
    "manufacturer": ("Manufacturer / Maker", "string", [
        "manufacturer", "maker", "part_manuf", "manufacturername", "mfr", "mfg", "oem",
        "producer"]),
    "supplier": ("Supplier / Vendor", "string", [
        "supplier", "vendor", "distributor", "seller", "wholesaler", "source_supplier"]),
    "category": ("Primary Category", "string", [
        "category", "cat", "product_category", "prod_cat", "department", "division",
        "segment", "family"]),
    "subcategory": ("Subcategory", "string", [
        "subcategory", "sub_category", "subcat", "type", "sub_type", "class", "group"]),
    "model_number": ("Model Number", "string", [
        "model_number", "model", "model_no", "model_code", "series", "type_code",
        "catalog_no"]),
    "price": ("Price / Unit Cost", "number", [
        "price", "unit_price", "cost", "msrp", "list_price", "rate", "amount",
        "sale_price"]),
    "currency": ("Currency", "string", [
        "currency", "curr", "currency_code", "price_unit", "curr_code"]),
    "voltage": ("Voltage Rating", "string", [
        "voltage", "voltagerating", "volts", "voltage_rating", "rated_voltage",
        "nominal_voltage", "vac", "vdc"]),
    "power": ("Power Rating", "string", [
        "power", "powerrating", "wattage", "rated_power", "hp", "kw", "capacity",
        "power_output"]),
    "frequency": ("Frequency", "string", [
        "frequency", "freq", "line_frequency", "hertz", "hz"]),
    "rpm": ("Rotational Speed (RPM)", "string", [
        "rpm", "speed", "rotational_speed", "max_rpm", "nominal_rpm"]),
    "weight": ("Weight / Mass", "string", [
        "weight", "weightkg", "weight_kg", "mass", "net_weight", "gross_weight",
        "weight_lbs"]),
    "dimensions": ("Dimensions (LxWxH)", "string", [
        "dimensions", "dim", "size", "measurements", "lxwxh", "package_dimensions"]),
    "material": ("Housing / Construction Material", "string", [
        "material", "housing_material", "construction", "body_material", "finish"]),
    "ip_rating": ("IP Ingress Protection Rating", "string", [
        "ip_rating", "ip_code", "ingress_protection", "protection_rating",
        "nema_rating", "enclosure_rating"]),
    "warranty": ("Warranty Period", "string", [
        "warranty", "warranty_period", "guarantee", "warranty_months",
        "warranty_years"]),
    "country": ("Country of Origin", "string", [
        "country", "country_of_origin", "coo", "origin", "mfg_country", "made_in"]),
    "product_url": ("Product URL / Link", "string", [
        "product_url", "url", "link", "web_url", "item_url", "page_url", "website"]),
    "technical_document": ("Technical Document / Datasheet", "string", [
        "technical_document", "datasheet", "spec_sheet", "pdf_url", "doc_url",
        "manual_url", "drawing"]),
    "source": ("Catalog Data Source", "string", [
        "source", "data_source", "feed", "catalog_source", "origin_system"]),
    "additional_attributes": ("Additional / Unmapped Attributes", "object", [
        "attributes", "extra", "custom_fields", "additional_attributes", "specs"]),
}
LEFTOVERS = "additional_attributes"

# Keys tried in order for each output field, first in the mapped
# fields and then among the raw columns of the same name.
FIELD_KEYS = {
    "product_id": ["product_identifier", "product_id", "id", "item_code", "product_code",
                   "sku", "mpn", "mfg_part_num"],
    "mpn": ["mpn", "mfg_part_num", "part_number", "partnumber", "model_number", "model"],
    "sku": ["sku", "stock_code", "inventory_id"],
    "model_number": ["model_number", "model", "model_no", "mpn", "sku"],
    "brand": ["brand", "brand_name", "e1_brand", "unilog_brand", "manufacturer", "maker",
              "part_manuf"],
    "manufacturer": ["manufacturer", "maker", "part_manuf", "brand", "brand_name"],
    "supplier": ["supplier", "vendor", "distributor", "seller"],
    "description": ["product_description", "description", "desc", "part_desc",
                    "longdescription", "details"],
    "product_name": ["product_name", "name", "title", "item_name", "product_title"],
    "category": ["category", "cat", "product_category", "department", "division"],
    "subcategory": ["subcategory", "sub_category", "subcat", "type", "class"],
    "power": ["power", "powerrating", "wattage", "rated_power", "hp", "kw"],
    "voltage": ["voltage", "voltagerating", "volts", "rated_voltage", "nominal_voltage"],
    "frequency": ["frequency", "freq", "line_frequency", "hz"],
    "rpm": ["rpm", "speed", "rotational_speed"],
    "weight": ["weight", "weightkg", "weight_kg", "mass", "net_weight"],
    "dimensions": ["dimensions", "dim", "size", "lxwxh"],
    "material": ["material", "housing_material", "construction"],
    "ip_rating": ["ip_rating", "ip_code", "ingress_protection", "protection_rating"],
    "warranty": ["warranty", "warranty_period", "guarantee"],
    "country": ["country", "country_of_origin", "coo", "origin"],
    "source": ["source", "data_source"],
    "technical_document": ["technical_document", "datasheet", "spec_sheet", "pdf_url"],
    "product_url": ["product_url", "url", "link"],
}

# Text used when a field cannot be filled from the row.
DEFAULT_NAME = "Industrial Equipment Component"
DEFAULT_CATEGORY = "Industrial Equipment"
DEFAULT_SOURCE = "Uploaded Catalog"
NAME_FROM_ID = "Industrial Component "
DESCRIPTION_FROM_NAME = ". Certified industrial component specification."

# Unit factors.
KW_PER_HP = 0.7457
KG_PER_LB = 0.453592
MM_PER_INCH = 25.4

# Validation patterns.
URL_PATTERN = (
    r"(?i)^(?:http|https)://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|"
    r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"
    r"(?::[0-9]+)?(?:/?|[/?]\S+)$"
)
IP_PATTERN = r"(?i)^IP[0-9]{2}[A-Z]?$"
POWER_UNITS_PATTERN = "kw|w|kva|hp|mw"

# Validation messages.
MSG_ID = "Product ID is missing or empty."
MSG_NAME = "Product name is missing or too short."
MSG_CATEGORY = "Category classification is missing."
MSG_BRAND = "Manufacturer/Brand is unspecified."
MSG_NO_PRICE = "Price is not specified or RFQ inquiry based."
MSG_NEGATIVE = "Price cannot be negative: "
MSG_POWER = "Power specification does not contain standard unit: "
MSG_VOLTAGE = "Voltage format is non-standard: "
MSG_IP = "IP Ingress Protection rating is non-standard format: "
MSG_URL = "Product URL is invalid or malformed: "
MSG_DOC = "Technical document link is malformed: "
MSG_DESCRIPTION = "Product description is sparse (< 20 characters) or missing."

# The 15 fields that count towards completeness.
CORE_FIELDS = [
    "product_id", "product_name", "brand", "category", "subcategory", "model_number",
    "description", "price", "voltage", "power", "weight", "dimensions", "ip_rating",
    "supplier", "product_url",
]

# Penalties and weights of the quality score.
SEVERITY_PENALTY = {"high": 0.35, "medium": 0.15, "low": 0.05}
SCORE_WEIGHTS = {"completeness": 0.35, "validity": 0.35, "consistency": 0.20, "agreement": 0.10}
AGREEMENT_IN_CONFLICT = 0.6

# Header parts that mark a brand feed, in check order.
BRAND_FEED_TAGS = ["e1_brand", "unilog_brand", "dib_brand", "part_manuf", "brand_name"]

# Display labels of issue fields.
FIELD_LABELS = {
    "description": "Product Description", "brand": "Brand", "manufacturer": "Manufacturer",
    "product_url": "Product URLs", "technical_document": "Documentation",
    "power": "Power Specifications", "voltage": "Voltage Specifications",
    "price": "Pricing & Commercials", "category": "Category", "subcategory": "Subcategory",
    "ip_rating": "IP Protection Rating", "product_id": "Part Number / SKU",
    "model_number": "Model Number", "weight": "Weight Specification",
    "dimensions": "Dimensions", "material": "Material Specs", "warranty": "Warranty Terms",
    "supplier": "Supplier Feeds", "attributes": "Technical Attributes",
}

# Gap report rows (name, counter, status), in report order.
GAP_ROWS = [
    ("Unilog Brand Feed", "unilog_brand", "Placeholder Ingestion"),
    ("E1 Brand Feed", "e1_brand", "Partial Feed"),
    ("DIB Brand Feed", "dib_brand", "Partial Feed"),
    ("Power Specification", "power", "Engineering Spec"),
    ("Voltage Rating", "voltage", "Electrical Spec"),
    ("Price & Commercials", "price", "Commercial Spec"),
    ("IP Protection Code", "ip_rating", "Environmental Spec"),
]

# Attribute names given by rule-based enrichment, with their source field.
ENRICHED_ATTRIBUTES = [
    ("rated_power", "power"), ("nominal_voltage", "voltage"),
    ("operating_frequency", "frequency"), ("rotational_speed", "rpm"),
    ("ingress_protection", "ip_rating"), ("net_weight", "weight"),
    ("physical_dimensions", "dimensions"), ("housing_material", "material"),
]
# Attributes reported as missing by enrichment, with their source field.
ENRICHED_MISSING = [
    ("IP Rating", "ip_rating"), ("Weight / Mass", "weight"),
    ("Physical Dimensions", "dimensions"), ("Warranty Terms", "warranty"),
    ("OEM Datasheet PDF", "technical_document"),
]
ENRICHED_CONFIDENCE = 0.88

# Clean-catalogue export columns, in file order, with their source field.
EXPORT_COLUMNS = [
    ("Product ID", "product_id"), ("Product Name", "product_name"), ("Brand", "brand"),
    ("Category", "category"), ("Subcategory", "subcategory"),
    ("Model Number", "model_number"), ("Price", "price"), ("Currency", "currency"),
    ("Voltage", "voltage"), ("Power", "power"), ("Frequency", "frequency"), ("RPM", "rpm"),
    ("Weight", "weight"), ("Dimensions", "dimensions"), ("IP Rating", "ip_rating"),
    ("Material", "material"), ("Warranty", "warranty"), ("Supplier", "supplier"),
    ("Source", "source"), ("Quality Score", "quality_score"),
    ("AI Confidence %", "ai_confidence"), ("Validation Status", "validation_status"),
    ("Cleaned Description", "description"), ("Product URL", "product_url"),
]

# Defaults shown in the product detail where a field is blank.
DETAIL_DEFAULTS = {
    "product_name": "Industrial Catalog Item", "brand": "Unbranded",
    "category": "Industrial Equipment", "subcategory": "General", "model_number": "N/A",
    "description": "No description provided.", "currency": "USD",
    "voltage": "Not available", "power": "Not available", "frequency": "Not available",
    "rpm": "Not available", "weight": "Not available", "dimensions": "Not available",
    "material": "Not available", "ip_rating": "Not available", "warranty": "Standard",
    "country": "Global", "supplier": "Industrial Distribution Master",
    "source": "Catalog Upload", "technical_document": "Not available",
    "product_url": "Not available",
}
