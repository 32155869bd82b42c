"""Fixed values and thresholds of the verification rules.

Everything here is small and constant: it is turned into literals inside the
plans, so nothing has to be read or broadcast at run time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: required statement ---------------------------------------
REQUIRED_STATEMENT = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not "
    "drink alcoholic beverages during pregnancy because of the risk of birth "
    "defects. (2) Consumption of alcoholic beverages impairs your ability to "
    "drive a car or operate machinery, and may cause health problems."
)

# --- fixed values: word lists ------------------------------------------------
BRAND_SUFFIXES = [
    "DISTILLERY", "DISTILLERS", "BREWING", "BREWERY", "WINERY", "VINEYARDS",
    "CELLARS", "IMPORTS", "SPIRITS", "ESTATES", "RESERVE",
]
CORPORATE_SUFFIXES = ["COMPANY", "CO", "INC", "LLC", "LTD", "CORP", "CORPORATION"]
OTHER_SUFFIXES = ["SELECTION"]

WARNING_WORDS = [
    "GOVERNMENT", "WARNING", "ACCORDING", "SURGEON", "GENERAL", "WOMEN", "SHOULD",
    "DRINK", "ALCOHOLIC", "BEVERAGES", "DURING", "PREGNANCY", "BECAUSE", "RISK",
    "BIRTH", "DEFECTS", "CONSUMPTION", "IMPAIRS", "ABILITY", "DRIVE", "CAR",
    "OPERATE", "MACHINERY", "CAUSE", "HEALTH", "PROBLEMS",
]
STOP_WORDS = [
    "AND", "THE", "OF", "OR", "BY", "NOT", "TO", "A", "IN", "ON", "AT", "FOR",
    "IT", "IS",
]
WARNING_KEYWORDS = [
    "GOVERNMENT", "WARNING", "SURGEON", "GENERAL", "ACCORDING", "ALCOHOLIC",
    "BEVERAGES", "PREGNANCY", "DEFECTS", "CONSUMPTION", "IMPAIRS", "MACHINERY",
    "HEALTH", "PROBLEMS", "DRIVE", "OPERATE",
]
SERVING_MARKERS = [
    "SERVINGS PER CONTAINER", "AMOUNT PER SERVING", "SERVING FACTS", "SERVING SIZE",
    "SERYING SIZE", "SERVINGS PER", "CALORIES", "CARBOHYDRATE", "ARBOHYDRATE",
    "FAT", "PROTEIN",
]
ORPHAN_SERVING_WORDS = [
    "CARBOHYDRATE", "ARBOHYDRATE", "PROTEIN", "CALORIES", "SERVING SIZE",
    "SERVINGS PER", "SERVINGS", "SERVING",
]
NUTRITION_SPLIT_WORDS = [
    "carbohydrate", "protein", "fat", "calories", "serving", "servings", "amount",
]
GENERIC_BRAND_TOKENS = [
    "brewery", "distillery", "winery", "inc", "co", "company", "llc", "ale", "beer",
    "spirits", "beverage", "beverages",
]
PANEL_MARKERS = ["Brand Label", "Back Label"]

CLASS_KEYWORDS = [
    "Vodka", "Gin", "Distilled Gin", "Compounded Gin", "Redistilled Gin", "Rum",
    "Tequila", "Mezcal", "Whiskey", "Whisky", "Bourbon", "Bourbon Whisky",
    "Bourbon Whiskey", "Rye Whisky", "Rye Whiskey", "Wheat Whisky", "Wheat Whiskey",
    "Malt Whisky", "Malt Whiskey", "Corn Whisky", "Corn Whiskey",
    "Straight Bourbon Whisky", "Straight Bourbon Whiskey", "Straight Rye Whisky",
    "Straight Rye Whiskey", "Straight Wheat Whisky", "Straight Wheat Whiskey",
    "Straight Malt Whisky", "Straight Malt Whiskey", "Straight Corn Whisky",
    "Straight Corn Whiskey", "Straight Whisky", "Straight Whiskey", "Light Whisky",
    "Light Whiskey", "Blended Whisky", "Blended Whiskey", "Blended Bourbon Whisky",
    "Blended Bourbon Whiskey", "Blended Rye Whisky", "Blended Rye Whiskey",
    "Spirit Whisky", "Spirit Whiskey", "Scotch Whisky", "Irish Whiskey",
    "Canadian Whisky", "Kentucky Straight Bourbon Whiskey", "Tennessee Whiskey",
    "Single Malt", "Single Barrel", "Single Pot Still", "Brandy", "Cognac",
    "Armagnac", "Calvados", "Pisco", "Grappa", "Fruit Brandy", "Applejack",
    "Liqueur", "Cordial", "Sloe Gin", "Amaretto", "Triple Sec", "Sambuca",
    "Absinthe", "Bitters", "Aquavit", "Neutral Spirits", "Grain Spirits",
    "Table Wine", "Light Wine", "Dessert Wine", "Red Wine", "Rose Wine", "White Wine",
    "American Red Wine", "American White Wine", "Sparkling Wine", "Champagne",
    "Carbonated Wine", "Fortified Wine", "Sherry", "Port", "Madeira", "Marsala",
    "Vermouth", "Sake", "Mead", "Honey Wine", "Fruit Wine", "Citrus Wine",
    "Berry Wine", "Agricultural Wine", "Retsina", "Natural Wine",
    "Special Natural Wine",
    "Beer", "Ale", "Lager", "Stout", "Porter", "Pale Ale", "India Pale Ale", "IPA",
    "Barleywine Ale", "Barleywine", "Barley Wine", "Pilsner", "Wheat Beer",
    "Hefeweizen", "Kolsch", "Saison", "Sour", "Gose", "Malt Liquor", "Malt Beverage",
    "Flavored Malt Beverage", "Hard Seltzer", "Hard Cider",
    "Straight", "Blended", "Reserve", "Aged", "Scotch", "Irish", "Canadian",
    "Kentucky", "Tennessee", "Shochu", "Baijiu", "Cachaca",
]

STRONG_CLASS_WORDS = [
    "BOURBON", "WHISKEY", "WHISKY", "VODKA", "GIN", "RUM", "TEQUILA", "BRANDY",
    "COGNAC", "WINE", "BEER", "ALE", "LAGER", "STOUT", "PORTER", "PILSNER", "SAKE",
    "MEAD", "STRAIGHT", "BLENDED", "SINGLE", "MALT", "KENTUCKY", "TENNESSEE",
    "SCOTCH", "IRISH", "CANADIAN",
]
CLASS_ADJECTIVES = [
    "SINGLE", "BARREL", "STRAIGHT", "BLENDED", "DOUBLE", "TRIPLE", "SMALL", "BATCH",
    "RESERVE", "AGED", "OLD", "AMERICAN", "WHISKEY", "WHISKY", "WINE", "ALE",
]
KNOWN_COUNTRIES = [
    "scotland", "ireland", "france", "italy", "spain", "germany", "mexico", "japan",
    "canada", "australia", "new zealand", "chile", "argentina", "brazil",
    "south africa", "netherlands", "belgium", "sweden", "norway", "denmark",
    "finland", "iceland", "portugal", "greece", "austria", "switzerland", "poland",
    "czech republic", "hungary", "romania", "india", "china", "south korea",
    "taiwan", "thailand", "philippines", "united kingdom", "england", "wales",
    "russia", "ukraine", "turkey", "israel", "peru", "colombia", "costa rica",
    "jamaica", "barbados", "trinidad", "guyana", "cuba", "dominican republic",
    "puerto rico", "guatemala", "nicaragua", "el salvador", "honduras", "panama",
]

# --- fixed values: patterns ---------------------------------------------------
HEADER_ONLY = (
    r"(?i)^(DISTILLED AND BOTTLED BY|BOTTLED BY|DISTILLED BY|PRODUCED BY|IMPORTED BY|"
    r"BREWED\s*[&]\s*BOTTLED BY|BREWED AND BOTTLED BY|BREWED BY|"
    r"GOVERNMENT WARNING|Brand Label|Back Label)[\s:]*$"
)
PANEL_MARKER = (
    r"(?i)^[↑↓\s]*Brand\s+Labels?\s*[↑↓\s]*$|^[↑↓\s]*Back\s+Labels?\s*[↑↓\s]*$"
)
BOTTLER_HEADER = (
    r"(?i)(Distilled\s+and\s+Bottled\s+by|Bottled\s+by|Distilled\s+by|Produced\s+by"
    r"|Produced\s+and\s+Bottled\s+by|Imported\s+by"
    r"|Brewed\s+(?:and|&)\s+Bottled\s+by|Brewed\s+by"
    r"|Manufactured\s+by|Made\s+by"
    r"|Cellared\s+and\s+Bottled\s+by|Vinted\s+and\s+Bottled\s+by"
    r"|Blended\s+and\s+Bottled\s+by)"
)
# a name starts where its run of characters starts: the first match does so anyway, and no
# other place has to be tried
BOTTLER_ADDRESS = (
    r"(?iU)(?<![\w\s&'])([\w\s&']+(?:Brewery|Distillery|Winery|Cellars|Imports|Vineyards"
    r"|Brewing\s+Company|Company))"
    r"[\s,]+([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\s*,\s*([A-Z]{2})\b"
)
ABV_STRICT = (
    r"(?i)(?:ALC\.?\s*)(\d+(?:\.\d+)?)\s*%\s*"
    r"(?:by\s+vol|Alc\.?/?Vol\.?|ALC/?VOL|alcohol\s+by\s+volume)"
)
ABV_QUALIFIED = (
    r"(?i)(\d+(?:\.\d+)?)\s*%\s*"
    r"(?:Alc\.?/?Vol\.?|ALC/?VOL|by\s+vol|alcohol\s+by\s+volume)"
)
ABV_LOOSE = r"(\d+(?:\.\d+)?)\s*%"
PROOF = r"(?i)(\d+(?:\.\d+)?)\s*(?:Proof)"
NET_CONTENTS = (
    r"(?i)(\d+(?:\.\d+)?)\s*"
    r"(mL\.?|L\.?|litre|liter|FL\.?\s*OZ\.?|FLUID\s+OUNCES?"
    r"|QT\.?|QUART|PT\.?|PINT|GAL\.?|GALLON)\b"
)
NET_COMPOUND = r"(?i)(\d+)\s*(PINT|PT\.?)\s+(\d+)\s*(FL\.?\s*OZ\.?|FLUID\s+OUNCES?)"
CITY_STATE = r"[A-Z][a-z]+,\s*[A-Z]{2}\b"
COUNTRY_PHRASE = (
    r"(?i)(?:Product|Produce|Wine|Vino)\s+(?:of|de)\s+(.+)"
    r"|Made\s+in\s+(.+)|Imported\s+from\s+(.+)|Origin\s*:\s*(.+)"
)

# --- fixed values: character pairs OCR mixes up (lower case, both directions) ---
CONFUSABLE_PAIRS = [
    ("l", "1"), ("i", "l"), ("i", "1"), ("o", "0"), ("s", "5"), ("b", "8"),
    ("rn", "m"), (",", "."), ("c", "e"),
]

# --- fixed values: class keyword -> inferred requirement -----------------------
CLASS_REQUIREMENTS = [
    ("state_of_distillation", [
        "Straight Bourbon", "Straight Rye", "Straight Wheat", "Straight Malt",
        "Straight Corn", "Straight Whiskey", "Straight Whisky", "Bourbon",
        "Tennessee Whiskey", "Tennessee Whisky",
    ]),
    ("neutral_spirits", ["Vodka", "Neutral Spirits", "Grain Spirits"]),
    ("country_of_origin", ["Scotch Whisky", "Scotch"]),
]

# --- fixed values: submitted column names -> record fields ---------------------
COLUMN_ALIASES = {
    "label id": "label_id", "brand name": "brand_name", "class type": "class_type",
    "alcohol pct": "alcohol_pct", "net contents": "net_contents_ml",
    "net contents ml": "net_contents_ml", "bottler name": "bottler_name",
    "bottler city": "bottler_city", "bottler state": "bottler_state",
    "country of origin": "country_of_origin", "beverage type": "beverage_type",
    "sulfites required": "sulfites_required", "fd&c yellow 5": "fd_c_yellow_5_required",
    "carmine required": "carmine_required", "wood treatment": "wood_treatment_required",
    "age statement": "age_statement_required", "age years": "age_years",
    "neutral spirits": "neutral_spirits_required",
}

# --- fixed values: report rows, in order ---------------------------------------
MATRIX_CRITERIA = [
    ("Brand Name", ["Brand name matches", "Brand name present"]),
    ("Type", ["Class/type matches", "Class/type present"]),
    ("Government Warning (All Caps)", ["GOVERNMENT WARNING in caps"]),
    ("Government Warning Wording", ["Exact warning wording", "Government warning present"]),
    ("Bottler/Producer", ["Bottler matches", "Bottler/producer statement"]),
    ("Bottler/Address", ["Bottler address"]),
    ("Country of Origin", ["Country of origin matches", "Country of origin"]),
    ("Alcohol content (ABV)",
     ["Alcohol content matches", "Alcohol content", "Alcohol content present"]),
    ("Proof", ["Proof matches", "Proof present", "Proof", "Proof/ABV consistency"]),
    ("Net contents", ["Net contents matches", "Net contents standard of fill",
                      "Net contents", "Net contents present"]),
    ("Sulfites", ["Sulfites statement"]),
    ("FD&C Yellow No. 5", ["FD&C Yellow No. 5"]),
    ("Cochineal/Carmine", ["Cochineal/Carmine statement"]),
    ("Wood treatment", ["Wood treatment"]),
    ("Age statement", ["Age statement"]),
    ("Neutral spirits", ["Neutral spirits / commodity"]),
    ("Aspartame", ["Aspartame statement"]),
    ("Appellation of origin", ["Appellation of origin"]),
    ("Varietal designation", ["Varietal designation"]),
]


@dataclass(frozen=True)
class RuleConfig:
    """Thresholds and lists that may be tuned without touching the plans."""

    match_pass: float = 0.90
    match_review: float = 0.70
    bottler_pass: float = 0.80
    bottler_same_as_brand: float = 0.75
    fuzzy_token_pct: int = 85
    text_token_pct: int = 80
    confusable_pct: int = 65
    overlap: float = 0.4
    similar_pct: int = 85
    abv_tolerance: float = 0.3
    proof_tolerance: float = 1.0
    net_tolerance_ml: int = 5
    whisky_age_years: int = 4
    sulfites_default_wine: bool = True
    standard_of_fill_ml: tuple = (
        50, 100, 200, 355, 375, 500, 700, 720, 750, 900, 1000, 1750, 1800,
    )
    abv_optional_types: tuple = ("beer",)
    required_statement: str = REQUIRED_STATEMENT
    generic_tokens: tuple = field(default=tuple(GENERIC_BRAND_TOKENS))


DEFAULT = RuleConfig()
