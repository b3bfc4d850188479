"""Fixed values.

Word lists, recoding tables and thresholds that must have exactly these values for results
to be right. They are defaults only: every operator takes them as parameters.
"""

# --- fixed values: material vocabulary (share columns, alphabetical) ---
MATERIALS = [
    "acrylic", "cashmere", "coated_fabric_pu", "cotton_conventional", "cotton_organic",
    "cotton_recycled", "down_feather", "down_synthetic", "elastane", "eva", "hemp", "jute",
    "leather_bovine", "leather_ovine", "leather_synthetic", "linen_flax", "lyocell_tencel",
    "metal_brass", "metal_gold", "metal_silver", "metal_steel", "modal", "natural_rubber",
    "polyamide_6", "polyamide_66", "polyamide_recycled", "polyester_recycled",
    "polyester_virgin", "rubber_synthetic", "silk", "tpu", "viscose", "wool_generic",
    "wool_merino",
]

# --- fixed values: material groups ---
HIGH_CARBON = [
    "leather_bovine", "leather_ovine", "wool_generic", "wool_merino", "silk", "cashmere",
    "down_feather",
]
SYNTHETIC = [
    "polyester_virgin", "polyester_recycled", "polyamide_6", "polyamide_66",
    "polyamide_recycled", "acrylic",
]
NATURAL = [
    "cotton_conventional", "cotton_organic", "cotton_recycled", "linen_flax", "hemp", "jute",
]
FOOTWEAR_ONLY = ["eva", "natural_rubber", "synthetic_rubber_sbr", "rubber_synthetic"]
FOOTWEAR_MATERIALS = ["leather_bovine"] + FOOTWEAR_ONLY

# --- fixed values: material names and their canonical form ---
ALIASES = {
    "cotton": "cotton_conventional",
    "down": "down_feather",
    "leather": "leather_bovine",
    "lycra": "elastane",
    "nylon": "polyamide_6",
    "polyamide": "polyamide_6",
    "polyester": "polyester_virgin",
    "rubber": "rubber_synthetic",
    "spandex": "elastane",
    "tencel": "lyocell_tencel",
    "viscose": "viscose",
    "wool": "wool_generic",
}
MATERIAL_RENAMES = {
    "cotton_virgin": "cotton_conventional",
    "nylon": "polyamide_6",
    "nylon_recycled": "polyamide_recycled",
    "polyamide_virgin": "polyamide_6",
    "polyester_66": "polyamide_66",
    "polyester_conventional": "polyester_virgin",
    "polyester_generic": "polyester_virgin",
    "rayon": "viscose",
    "recycled_polyester": "polyester_recycled",
}
MATERIAL_RENAMES_FULL = MATERIAL_RENAMES | {"rubber_synthetic": "synthetic_rubber_sbr"}

# --- fixed values: wrong material names by class, as a report names them ---
ERROR_CLASSES = {
    "typos": [
        "poliamide_6", "polluster_recycled", "polporter_virgin", "polyamid_6", "polyster_virgin",
        "viscane", "viscluse", "visise", "visvester_virgin", "visyester_virgin",
    ],
    "corrupted": ["pol<seg_125>_virgin"],
    "japanese": ["polリエステル_recycled", "polリエステル_virgin"],
    "spacing": ["pol polyamide_6", "pol polyester_recycled", "pol polyester_virgin"],
    "impossible": ["coated_bovine", "polyester_bovine", "polyester_organic"],
}

# --- fixed values: wrong material names of the audit and the first cleanup ---
ERRONEOUS_AUDIT = [
    "coated_bovine", "elastamide_66", "elastester_virgin", "elastical", "leather_b_ovine",
    "leather_bvine", "pol polyamide_6", "pol polyester_recycled", "pol polyester_virgin",
    "pol<seg_125>_virgin", "poliamide_6", "polluster_recycled", "polporter_virgin", "polyamid_6",
    "polyester_6", "polyester_bovine", "polyster_virgin", "polリエステル_recycled",
    "polリエステル_virgin", "viscane", "viscluse", "visise", "visvester_virgin", "visyester_virgin",
]

# --- fixed values: wrong material names of the final data set ---
ERRONEOUS_FINAL = [
    "coated_bovine", "elastamide_66", "elastester_virgin", "elastical", "leather_b_ovine",
    "leather_bvine", "pol polyamide_6", "pol polyester_recycled", "pol polyester_virgin",
    "pol<seg_125>_virgin", "poliamide_6", "polluster_recycled", "polporter_virgin", "polyamid_6",
    "polyester_6", "polyester_bovine", "polyester_organic", "polyster_virgin",
    "polリエステル_recycled", "polリエステル_virgin", "viscane", "viscluse", "visise",
    "visvester_virgin", "visyester_virgin",
]
QUESTIONABLE = [
    "cotton_recycled", "cotton_virgin", "nylon", "nylon_recycled", "polyamide_virgin",
    "polyester_66", "polyester_conventional", "polyester_generic", "polyester_organic",
    "rayon", "recycled_polyester", "rubber_synthetic", "shearling_faux",
]
IMPOSSIBLE_MATERIALS = ["polyester_organic"]

# --- fixed values: recoding of gender and category ---
GENDER_RECODE = {"Men's": "Male", "Women's": "Female"}
GENDERS = ["Female", "Male"]
PARENTS = ["Bottoms", "Dresses", "Footwear", "Outerwear", "Tops"]
CATEGORY_RENAMES = {
    "Athwear": "Athletic Shoes",
    "Denem Jackets": "Denim Jackets",
    "Denim Overalls": "Jumpsuits",
    "Denim Pants": "Jeans",
    "Denim Shorts": "Shorts",
    "Denim Trousers": "Jeans",
    "Downwear": "Down Jackets",
    "Jackwear": "Jackets",
    "Loafwear": "Loafers",
    "Maxi Dresses": "Maxi",
    "Maxi Skirt": "Maxi Skirts",
    "Midi Dresses": "Midi",
    "Mini Dresses": "Mini",
    "Rainwear": "Raincoats",
    "Sandwear": "Sandals",
    "Sweatpants & Jogpants": "Sweatpants & Joggers",
}
CATEGORY_STANDARD = {
    "Maxi": "Maxi Dresses",
    "Midi": "Midi Dresses",
    "Mini": "Mini Dresses",
    "Sweaters & Knitwear": "Sweaters",
    "Sweatpants": "Joggers",
    "Sweatpants & Joggers": "Joggers",
    "Sweatshirts & Hoodies": "Hoodies",
}

# --- fixed values: categories expected below each parent ---
CATEGORIES_BY_PARENT = {
    "Bottoms": [
        "Casual Pants", "Cropped Pants", "Denim", "Jeans", "Joggers", "Jumpsuits", "Leggings",
        "Maxi Skirts", "Midi Skirts", "Mini Skirts", "Pants", "Shorts", "Sweatpants",
        "Sweatpants & Joggers", "Swimwear",
    ],
    "Dresses": [
        "Dresses", "Gowns", "Maxi", "Maxi Dresses", "Midi", "Midi Dresses", "Mini",
        "Mini Dresses",
    ],
    "Footwear": [
        "Athletic Shoes", "Boots", "Casual Shoes", "Dress Shoes", "Flats", "Heels", "Loafers",
        "Sandals", "Sneakers",
    ],
    "Outerwear": [
        "Blazers", "Bombers", "Cloaks & Capes", "Coats", "Denim Jackets", "Down Jackets",
        "Fur & Faux Fur", "Heavy Coats", "Jackets", "Leather Jackets", "Light Jackets",
        "Parkas", "Rain Jackets", "Raincoats", "Vests",
    ],
    "Tops": [
        "Blouses", "Bodysuits", "Button-Ups", "Crop Tops", "Hoodies", "Jerseys",
        "Long Sleeve Shirts", "Polos", "Short Sleeve Shirts", "Sleeveless", "Sweaters",
        "Sweaters & Knitwear", "Sweatshirts", "Sweatshirts & Hoodies", "Tank Tops",
    ],
}
EXPECTED_PARENT = {c: parent for parent, cats in CATEGORIES_BY_PARENT.items() for c in cats}
TYPICALLY_FEMALE = ["Blouses", "Gowns", "Heels", "Maxi Dresses", "Midi Dresses", "Mini Dresses"]
NAMING_VARIANTS = {
    "dress": ["Maxi", "Maxi Dresses", "Midi", "Midi Dresses", "Mini", "Mini Dresses"],
    "hoodie": ["Hoodies", "Sweatshirts", "Sweatshirts & Hoodies"],
    "sweater": ["Sweaters", "Sweaters & Knitwear"],
    "sweatpants": ["Joggers", "Sweatpants", "Sweatpants & Joggers"],
}
DEFICIT_SYNONYMS = {"Maxi Dresses": "Maxi", "Midi Dresses": "Midi", "Mini Dresses": "Mini"}
DEFICIT_CATEGORIES = ["Gowns", "Maxi", "Midi", "Mini"]

# --- fixed values: bands as (label, low, low_closed, high, high_closed) ---
WEIGHT_BANDS_5 = [
    ("extreme_low", None, False, 0.01, False),
    ("low", 0.01, True, 0.05, False),
    ("normal", 0.05, True, 5.0, True),
    ("high", 5.0, False, 10.0, True),
    ("extreme_high", 10.0, False, None, False),
]
WEIGHT_BANDS_7 = [
    ("nano", None, False, 0.001, False),
    ("micro", 0.001, True, 0.01, False),
    ("very_light", 0.01, True, 0.1, False),
    ("light", 0.1, True, 1.0, False),
    ("normal", 1.0, True, 5.0, False),
    ("heavy", 5.0, True, 10.0, False),
    ("very_heavy", 10.0, True, None, False),
]
WEIGHT_BANDS_7_CLOSED = WEIGHT_BANDS_7[:4] + [
    ("normal", 1.0, True, 5.0, True),
    ("heavy", 5.0, False, 10.0, True),
    ("very_heavy", 10.0, False, None, False),
]
DISTANCE_BANDS_8 = [
    ("extreme_low", None, False, 1.0, False),
    ("local", 1.0, True, 100.0, False),
    ("regional", 100.0, True, 1000.0, False),
    ("continental", 1000.0, True, 5000.0, False),
    ("intercontinental", 5000.0, True, 15000.0, False),
    ("trans_pacific", 15000.0, True, 25000.0, False),
    ("around_world", 25000.0, True, 40000.0, False),
    ("impossible", 40000.0, True, None, False),
]
DISTANCE_BANDS_5 = [
    ("0-1000", 0.0, True, 1000.0, False),
    ("1000-10000", 1000.0, True, 10000.0, False),
    ("10000-20000", 10000.0, True, 20000.0, False),
    ("20000-30000", 20000.0, True, 30000.0, False),
    ("30000-40000", 30000.0, True, 40000.0, False),
]
RARITY_TIERS = [("very_rare", 10), ("rare", 100), ("uncommon", 1000), ("common", 10000)]

# --- fixed values: (text in the name, issue, correct form), first match counts ---
NAME_ISSUES = [
    ("polyamide_virgin", "Redundant variant", "polyamide_6 or polyamide_66"),
    ("=nylon", "Synonym", "polyamide_6 or polyamide_66"),
    ("polyester_66", "Wrong number", "polyamide_66 (not polyester)"),
    ("polyester_conventional", "Redundant naming", "polyester_virgin"),
    ("recycled_polyester", "Naming inconsistency", "polyester_recycled"),
    ("polyester_generic", "Vague naming", "polyester_virgin"),
    ("cotton_virgin", "Redundant variant", "cotton_conventional"),
    ("nylon_recycled", "Synonym (inconsistent)", "polyamide_recycled"),
    ("polyamide_recycled", "Legitimate (rare)", "OK (just very rare)"),
    ("cotton_recycled", "Legitimate (rare)", "OK (just very rare)"),
    ("shearling_faux", "Legitimate (rare)", "OK (faux shearling lining)"),
    ("rayon", "Missing designation", "viscose (rayon = viscose)"),
]
RARE_ASSESSMENTS = [
    ("jute", "Legitimate (espadrilles, eco products)"),
    ("wool_merino", "Legitimate (premium wool variant)"),
    ("cashmere", "Legitimate (luxury material)"),
]
NOISE_PREFIXES = ["here", "note", "csv", "product_name", "output", "example"]

# --- fixed values: freight modes as (mode, g CO2e per tkm, beta0, beta1) ---
MODES = [
    ("road", 72.9, 0.0, 0.0),
    ("rail", 22.0, -10.537, 1.372),
    ("inland_waterway", 31.0, -5.77, 0.762),
    ("sea", 10.3, -17.108, 2.364),
    ("air", 782.0, -17.345, 1.881),
]

# --- fixed values: ranges ---
WEIGHT_RANGE = (0.01, 50.0)
DISTANCE_RANGE = (1.0, 40000.0)
MAX_DISTANCE_KM = 40000.0
EARTH_CIRCUMFERENCE_KM = 40075.0
UNIT_LOW_KG = 0.01
UNIT_HIGH_KG = 10.0
QUICK_FREIGHT_G_PER_TKM = 50.0
DEFAULT_CARBON_FACTOR = 3.0
DEFAULT_WATER_FACTOR = 3000.0

# --- fixed values: model gates, dropout and target weights ---
MASK_RATES = {"weight": 0.15, "distance": 0.25, "materials": 0.10}
TEST_LEVELS = [0.0, 0.2, 0.4]
TEST_TRIALS = 3
GATE = {
    "r2_min": 0.80,
    "mae_carbon_max": 0.50,
    "robust_r2_min": 0.70,
    "degradation_max": 0.20,
}
TARGET_WEIGHTS = {
    "carbon_material": 0.3,
    "carbon_transport": 0.2,
    "carbon_total": 0.3,
    "water_total": 0.2,
}
