"""Hand-written labels used by the extraction and rule tests."""

WARNING_LINES = [
    "(1) According to the Surgeon General,",
    "women should not drink alcoholic beverages",
    "during pregnancy because of the risk of",
    "birth defects.",
    "(2) Consumption of alcoholic beverages",
    "impairs your ability to drive a car or operate",
    "machinery, and may cause health problems.",
]


def lines(*texts, x=10, y=10, step=40, height=30):
    """Blocks one under the other: (text, x1, y1, x2, y2)."""
    return [
        (t, x, y + i * step, x + 8 * len(t), y + i * step + height) for i, t in enumerate(texts)
    ]


LAYOUTS = {
    "one_line": [
        ("OLD TOM DISTILLERY", 10, 10, 200, 40),
        ("Kentucky Straight Bourbon Whiskey", 10, 50, 300, 80),
        ("45% Alc./Vol. (90 Proof)", 10, 90, 180, 120),
        ("750 mL", 10, 130, 80, 160),
        ("GOVERNMENT WARNING:", 10, 200, 220, 230),
        ("According to the Surgeon General...", 10, 235, 400, 265),
        ("Bottled by Old Tom Distillery, Louisville, KY", 10, 260, 350, 290),
    ],
    "two_panel": [
        ("DISTILLED AND BOTTLED BY:", 20, 20, 250, 45),
        ("ABC DISTILLERY", 40, 50, 210, 85),
        ("FREDERICK, MD", 50, 90, 190, 110),
        ("ABC", 60, 130, 190, 200),
        ("SINGLE BARREL", 40, 210, 210, 240),
        ("STRAIGHT RYE", 30, 250, 220, 285),
        ("WHISKY", 50, 290, 200, 325),
        ("750 ML", 30, 350, 120, 375),
        ("45% ALC/VOL", 30, 380, 150, 405),
        ("ABC", 320, 30, 420, 70),
        ("STRAIGHT RYE WHISKY", 300, 80, 470, 105),
        ("GOVERNMENT WARNING:", 300, 120, 480, 145),
        *[(t, 300, 150 + 25 * i, 490, 170 + 25 * i) for i, t in enumerate(WARNING_LINES)],
    ],
    "split_abv": [
        ("BRAND X", 10, 10, 150, 50),
        ("Vodka", 10, 60, 100, 85),
        ("45", 10, 100, 40, 120),
        ("% ALC/VOL", 45, 100, 140, 120),
        ("750", 10, 130, 50, 150),
        ("mL", 55, 130, 80, 150),
        ("GOVERNMENT WARNING:", 10, 180, 200, 200),
        ("According to the Surgeon General...", 10, 210, 350, 235),
    ],
    "compound_net": [
        ("MALT & HOP BREWERY", 10, 10, 250, 50),
        ("PALE ALE", 10, 60, 120, 85),
        ("1 PINT 8 FL OZ", 10, 95, 180, 115),
        ("5% ALC/VOL", 10, 120, 120, 140),
        ("GOVERNMENT WARNING:", 10, 180, 200, 200),
        ("According to the Surgeon General...", 10, 210, 350, 235),
        ("Bottled by Malt & Hop Brewery, Hyattsville, MD", 10, 250, 350, 275),
    ],
    "over_collection": [
        ("DOWNUNDER WINERY", 10, 10, 200, 45),
        ("RED WINE", 10, 50, 120, 75),
        ("VICTORIA", 10, 80, 100, 100),
        ("12% ALC./VOL.", 10, 110, 140, 130),
        ("IMPORTED BY OZ IMPORTS", 10, 140, 220, 160),
        ("Product of Australia", 10, 165, 180, 185),
        ("CONTAINS SULFITES", 10, 190, 160, 210),
        ("750 ML", 10, 215, 80, 235),
        ("GOVERNMENT WARNING:", 10, 260, 200, 280),
        ("(1) According to the Surgeon General...", 10, 285, 350, 305),
    ],
    "barleywine": [
        ("TIGER'S SPECIAL", 10, 10, 200, 50),
        ("Barleywine Ale", 10, 55, 160, 80),
        ("12 FLUID OUNCES", 10, 90, 150, 110),
        ("9% ALC/VOL", 10, 115, 110, 135),
        ("BREWED & BOTTLED BY:", 10, 160, 200, 180),
        ("Tiger Brewing, Portland, OR", 10, 185, 250, 205),
        ("GOVERNMENT WARNING:", 10, 230, 200, 250),
        ("According to the Surgeon General...", 10, 255, 350, 275),
    ],
    "prominence": [
        ("SMALL TEXT", 10, 10, 100, 25),
        ("BIG BRAND", 10, 40, 300, 120),
        ("Vodka", 10, 130, 100, 155),
    ],
    "abv_qualified_wins": [
        ("BRAND", 10, 10, 100, 30), ("1 PINT 8 FL OZ15%", 10, 40, 200, 60),
        ("5% ALC/VOL", 10, 70, 120, 90),
    ],
    "abv_by_vol": [("ALC. 12% BY VOL.", 10, 10, 180, 30)],
    "abv_loose": [("BRAND", 10, 10, 100, 30), ("40%", 10, 40, 60, 60)],
    "abv_not_share": [("50% MERLOT", 10, 10, 120, 30), ("13% ALC./VOL.", 10, 40, 150, 60)],
    "net_quart": [("BRAND", 10, 10, 100, 30), ("1 QT.", 10, 40, 70, 60)],
    "net_ounces": [("BRAND", 10, 10, 100, 30), ("12 FLUID OUNCES", 10, 40, 160, 60)],
    "class_before_bottler": [("PALE ALE", 10, 10, 100, 30), ("Bottled by XYZ", 10, 35, 150, 55)],
    "brand_winery": [("ABC WINERY", 10, 10, 200, 50), ("Red Wine", 10, 55, 100, 75)],
    "brand_inc": [("ACME INC", 10, 10, 200, 50), ("Vodka", 10, 55, 100, 75)],
    "brand_bare_suffix": [("RIVER BEND", 10, 10, 200, 50), ("CO", 10, 55, 100, 75)],
    "brand_trailing": [
        ("ABC DISTILLERY FREDERICK, MD", 10, 10, 300, 50), ("Bourbon", 10, 55, 100, 75),
    ],
    "brand_brewing_co": [
        ("TIGER BREWING CO PORTLAND OR", 10, 10, 400, 50), ("Ale", 10, 55, 60, 75),
    ],
    "country_product": [("Product of Scotland", 10, 10, 200, 30)],
    "country_made": [("Made in France", 10, 10, 200, 30)],
    "country_imported": [("Imported from Japan", 10, 10, 200, 30)],
    "country_produce": [("Produce of Italy", 10, 10, 200, 30)],
    "country_wine": [("Wine of Chile", 10, 10, 200, 30)],
    "country_alone": [("Some brand", 10, 10, 200, 30), ("Scotland", 10, 40, 100, 55)],
    "country_long_text": [
        ("GOVERNMENT WARNING: According to the Surgeon General, women should not drink "
         "alcoholic beverages during pregnancy because of the risk of birth defects in France.",
         10, 10, 500, 60),
    ],
    "address_fallback": lines("FINE GOODS", "Blue Hill Winery, Salem, OR"),
    "seal_fallback": lines("WOODFORD DSP KY-52 SERIES", "Bourbon Whiskey"),
    "side_panel": [
        ("GOVERNMENT WARNING: (1) According to the Surgeon General,", 10, 100, 400, 120),
        ("Serving Facts", 600, 100, 700, 120),
        ("women should not drink alcoholic beverages during pregnancy", 10, 130, 400, 150),
        ("Health claims and Carbohydrate 5g", 600, 130, 800, 150),
        ("because of the risk of birth defects. (2) Consumption of alcoholic beverages",
         10, 160, 400, 180),
        ("impairs your ability to drive a car or operate machinery, and | Protein 2g",
         10, 190, 400, 210),
        ("may cause health problems.", 10, 220, 400, 240),
    ],
}


def block_rows():
    return [
        (name, i, t, x1, y1, x2, y2, 90.0 - i)
        for name, blocks in LAYOUTS.items()
        for i, (t, x1, y1, x2, y2) in enumerate(blocks)
    ]
