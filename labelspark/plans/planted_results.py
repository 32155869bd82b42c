"""What the rules have to say about the planted labels, case by case.

Listed from a run and then read against the specification of each rule: case, rule, status, message, value
on the label, value of the application. Rows are of the category that the case is about.
"""

from __future__ import annotations

from labelspark.config import REQUIRED_STATEMENT as WHOLE

PLANTED_RESULTS: list[tuple[int, str, str, str, str, str]] = [
    (0, "Brand name present", "fail", "Brand name not found on label.", "", "Old Crow"),
    (0, "Class/type matches", "pass", "Class/type matches (exact).", "Gin", "Gin"),
    (1, "Brand name present", "needs_review", "Brand name found on label — add to application for verification.", "Old Crow", ""),
    (1, "Class/type matches", "pass", "Class/type matches (exact).", "Gin", "Gin"),
    (2, "Brand name matches", "pass", "Brand name matches (exact_ocr_normalized).", "0ld Cr0w", "Old Crow"),
    (2, "Class/type matches", "pass", "Class/type matches (exact).", "Gin", "Gin"),
    (3, "Brand name matches", "pass", "Brand name matches (token_containment).", "Old Crow Reserve", "Old Crow"),
    (3, "Class/type matches", "pass", "Class/type matches (exact).", "Gin", "Gin"),
    (4, "Brand name matches", "needs_review", "Brand name similar but not exact (fuzzy_ratio, 79%).", "abcdefghijkx", "abcdefghijklmnop"),
    (4, "Class/type matches", "pass", "Class/type matches (exact).", "Gin", "Gin"),
    (5, "Brand name matches", "needs_review", "Brand name similar but not exact (fuzzy_ratio, 70%) — likely OCR misread.", "abcdefgxyz", "abcdefghij"),
    (5, "Class/type matches", "pass", "Class/type matches (exact).", "Gin", "Gin"),
    (6, "Brand name matches", "pass", "Brand name found on label (tokens in full text).", "abcdefgxyz", "abcdefghij"),
    (6, "Class/type matches", "pass", "Class/type matches (exact).", "Gin", "Gin"),
    (7, "Brand name matches", "fail", "Brand name mismatch (0%).", "Qzwv", "Stone Bridge"),
    (7, "Class/type matches", "pass", "Class/type matches (exact).", "Gin", "Gin"),
    (8, "Brand name matches", "pass", "Brand name found on label (tokens in full text).", "Qzwv", "Stone Bridge"),
    (8, "Class/type matches", "pass", "Class/type matches (exact).", "Gin", "Gin"),
    (9, "Brand name matches", "needs_review", "Brand name differs — likely OCR misread, verify manually (67%).", "abcdefxyz", "abcdefghi"),
    (9, "Class/type matches", "pass", "Class/type matches (exact).", "Gin", "Gin"),
    (10, "Brand name matches", "pass", "Brand name matches (exact).", "Old Crow", "Old Crow"),
    (10, "Class/type present", "fail", "Class/type not found on label.", "", "Gin"),
    (11, "Brand name matches", "pass", "Brand name matches (exact).", "Old Crow", "Old Crow"),
    (11, "Class/type present", "needs_review", "Class/type found on label — add to application for verification.", "Gin", ""),
    (12, "Brand name matches", "pass", "Brand name matches (exact).", "Old Crow", "Old Crow"),
    (12, "Class/type matches", "needs_review", "Class/type similar but not exact (reverse_containment_partial, 88%).", "Rye Whisky", "Straight Rye Whisky"),
    (13, "Brand name matches", "pass", "Brand name matches (exact).", "Old Crow", "Old Crow"),
    (13, "Class/type matches", "needs_review", "Class/type similar but not exact (fuzzy_ratio, 79%).", "abcdefghijkx", "abcdefghijklmnop"),
    (14, "Brand name matches", "pass", "Brand name matches (exact).", "Old Crow", "Old Crow"),
    (14, "Class/type matches", "pass", "Class/type found on label (tokens in full text).", "abcdefgxyz", "abcdefghij"),
    (15, "Brand name matches", "pass", "Brand name matches (exact).", "Old Crow", "Old Crow"),
    (15, "Class/type matches", "fail", "Class/type mismatch (0%).", "Qzwv", "Pale Ale"),
    (16, "Brand name matches", "pass", "Brand name matches (exact).", "Old Crow", "Old Crow"),
    (16, "Class/type matches", "needs_review", "Application class 'Pale Ale' found on label but extracted class is 'Qzwv' — verify.", "Qzwv", "Pale Ale"),
    (17, "Brand name matches", "pass", "Brand name matches (exact).", "Old Crow", "Old Crow"),
    (17, "Class/type matches", "needs_review", "Class/type differs — likely OCR misread, verify manually (67%).", "abcdefxyz", "abcdefghi"),
    (18, "Alcohol content present", "fail", "Alcohol content (ABV) not found on label.", "", "40"),
    (18, "Proof", "pass", "Proof present and matches.", "80", "80"),
    (18, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (19, "Alcohol content present", "pass", "Alcohol content not required for this beverage type.", "", "40"),
    (19, "Proof", "pass", "Proof not applicable for this beverage type.", "80", "80"),
    (19, "Net contents matches", "needs_review", "Net contents on label (333 mL ≈ 333 mL) does not match application (750 mL ≈ 750 mL).", "333 mL", "750 mL"),
    (20, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40.2"),
    (20, "Proof", "pass", "Proof present and matches.", "80", "80"),
    (20, "Proof/ABV consistency", "pass", "Proof and ABV are consistent (proof = 2 × ABV).", "80", "80"),
    (20, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (21, "Alcohol content", "pass", "Alcohol content present.", "4S", "45"),
    (21, "Proof matches", "needs_review", "Proof on label (90) does not match application (80).", "90", "80"),
    (21, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (22, "Alcohol content matches", "needs_review", "ABV on label (18%) does not match application (13%).", "18", "13"),
    (22, "Proof", "pass", "Proof not applicable for this beverage type.", "80", "80"),
    (22, "Proof/ABV consistency", "needs_review", "Proof (80) does not equal 2× ABV (18%). Expected proof ≈ 36.", "80", "proof = 2 × ABV"),
    (22, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (23, "Alcohol content", "pass", "Alcohol content present.", "40", "forty"),
    (23, "Proof", "pass", "Proof present and matches.", "80", "80"),
    (23, "Proof/ABV consistency", "pass", "Proof and ABV are consistent (proof = 2 × ABV).", "80", "80"),
    (23, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (24, "Alcohol content", "needs_review", "Alcohol content found on label — add to application for verification.", "40", ""),
    (24, "Proof", "pass", "Proof present and matches.", "80", "80"),
    (24, "Proof/ABV consistency", "pass", "Proof and ABV are consistent (proof = 2 × ABV).", "80", "80"),
    (24, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (25, "Alcohol content matches", "needs_review", "ABV on label (23.41%) differs from application (123.4%) — likely OCR misread, verify manually.", "23.41", "123.4"),
    (25, "Proof present", "needs_review", "Proof not found on label but specified in application.", "", "80"),
    (25, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (26, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40"),
    (26, "Proof present", "needs_review", "Proof not found on label but specified in application.", "", "80"),
    (26, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (27, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40"),
    (27, "Proof matches", "pass", "Proof matches after OCR normalization (8O ≈ 80).", "8O", "80"),
    (27, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (28, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40"),
    (28, "Proof matches", "needs_review", "Proof on label (80) does not match application (90).", "80", "90"),
    (28, "Proof/ABV consistency", "pass", "Proof and ABV are consistent (proof = 2 × ABV).", "80", "90"),
    (28, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (29, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40"),
    (29, "Proof", "pass", "Proof present and matches.", "86", ""),
    (29, "Proof/ABV consistency", "needs_review", "Proof (86) does not equal 2× ABV (40%). Expected proof ≈ 80.", "86", "proof = 2 × ABV"),
    (29, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (30, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40"),
    (30, "Proof matches", "needs_review", "Proof on label (234) differs from application (1234) — likely OCR misread, verify manually.", "234", "1234"),
    (30, "Proof/ABV consistency", "needs_review", "Proof (234) does not equal 2× ABV (40%). Expected proof ≈ 80.", "234", "proof = 2 × ABV"),
    (30, "Net contents", "pass", "Net contents found: 750 mL.", "750 mL", "750 mL"),
    (31, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40"),
    (31, "Proof", "pass", "Proof present and matches.", "80", "80"),
    (31, "Proof/ABV consistency", "pass", "Proof and ABV are consistent (proof = 2 × ABV).", "80", "80"),
    (31, "Net contents present", "fail", "Net contents not found on label.", "", "750 mL"),
    (32, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40"),
    (32, "Proof", "pass", "Proof present and matches.", "80", "80"),
    (32, "Proof/ABV consistency", "pass", "Proof and ABV are consistent (proof = 2 × ABV).", "80", "80"),
    (32, "Net contents present", "needs_review", "Net contents found on label — add to application for verification.", "750 mL", ""),
    (33, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40"),
    (33, "Proof", "pass", "Proof present and matches.", "80", "80"),
    (33, "Proof/ABV consistency", "pass", "Proof and ABV are consistent (proof = 2 × ABV).", "80", "80"),
    (33, "Net contents standard of fill", "needs_review", "Net contents '740 mL' is not a TTB authorized standard of fill.", "740 mL", "740 mL"),
    (34, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40"),
    (34, "Proof", "pass", "Proof present and matches.", "80", "80"),
    (34, "Proof/ABV consistency", "pass", "Proof and ABV are consistent (proof = 2 × ABV).", "80", "80"),
    (34, "Net contents matches", "needs_review", "Net contents on label (750 mL ≈ 750 mL) does not match application (1 L ≈ 1000 mL).", "750 mL", "1 L"),
    (35, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40"),
    (35, "Proof", "pass", "Proof present and matches.", "80", "80"),
    (35, "Proof/ABV consistency", "pass", "Proof and ABV are consistent (proof = 2 × ABV).", "80", "80"),
    (35, "Net contents standard of fill", "needs_review", "Net contents '740 mL' is not a TTB authorized standard of fill.", "740 mL", "1 L"),
    (35, "Net contents matches", "needs_review", "Net contents on label (740 mL ≈ 740 mL) does not match application (1 L ≈ 1000 mL).", "740 mL", "1 L"),
    (36, "Alcohol content matches", "pass", "Alcohol content present and matches.", "40", "40"),
    (36, "Proof", "pass", "Proof present and matches.", "80", "80"),
    (36, "Proof/ABV consistency", "pass", "Proof and ABV are consistent (proof = 2 × ABV).", "80", "80"),
    (36, "Net contents matches", "needs_review", "Net contents on label (750 mL ≈ 750 mL) does not match application (75 mL ≈ 75 mL) — likely OCR misread, verify manually.", "750 mL", "75 mL"),
    (37, "Government warning present", "fail", "Government warning statement not found on label.", "", "Required"),
    (38, "GOVERNMENT WARNING in caps", "fail", "The phrase 'GOVERNMENT WARNING' must appear in all caps.", "Official note: (1) According to the Surgeon General, women s", "GOVERNMENT WARNING"),
    (38, "Exact warning wording", "needs_review", "Key phrases present but: missing required words; extra words: ['NOTE', 'OFFICIAL']; critical phrases (BIRTH DEFECTS, HEALTH PROBLEMS) out of order or too far apart.", "Official note: (1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.", WHOLE),
    (39, "GOVERNMENT WARNING in caps", "pass", "GOVERNMENT WARNING appears in required form.", "GOVERNMENT WARNING", "GOVERNMENT WARNING"),
    (39, "Exact warning wording", "fail", "Warning text appears incomplete or incorrect.", "GOVERNMENT WARNING: drink less", WHOLE),
    (40, "GOVERNMENT WARNING in caps", "pass", "GOVERNMENT WARNING appears in required form.", "GOVERNMENT WARNING", "GOVERNMENT WARNING"),
    (40, "Exact warning wording", "needs_review", "Key phrases present but: extra words: ['ZEBRA']; critical phrases (BIRTH DEFECTS, HEALTH PROBLEMS) out of order or too far apart.", "GOVERNMENT WARNING: (1) According to the Surgeon General, women zebra should not drink alcoholic beverages during pregnancy because of the risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.", WHOLE),
    (41, "GOVERNMENT WARNING in caps", "pass", "GOVERNMENT WARNING appears in required form.", "GOVERNMENT WARNING", "GOVERNMENT WARNING"),
    (41, "Exact warning wording", "needs_review", "Key phrases present but: missing required words; critical phrases (BIRTH DEFECTS, HEALTH PROBLEMS) out of order or too far apart.", "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to drive or operate machinery, and may cause health problems.", WHOLE),
    (42, "GOVERNMENT WARNING in caps", "pass", "GOVERNMENT WARNING appears in required form.", "GOVERNMENT WARNING", "GOVERNMENT WARNING"),
    (42, "Exact warning wording", "needs_review", "Key phrases present but: extra words: ['ZEBRA']; critical phrases (BIRTH DEFECTS, HEALTH PROBLEMS) out of order or too far apart; Surgeon General not capitalized.", "GOVERNMENT WARNING: (1) According to the surgeon general, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to drive zebra a car or operate machinery, and may cause health problems.", WHOLE),
    (43, "GOVERNMENT WARNING in caps", "pass", "GOVERNMENT WARNING appears in required form.", "GOVERNMENT WARNING", "GOVERNMENT WARNING"),
    (43, "Exact warning wording", "needs_review", "Only one statement found; both (1) and (2) required. Missing: statement (2).", "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects.", WHOLE),
    (44, "GOVERNMENT WARNING in caps", "pass", "GOVERNMENT WARNING appears in required form.", "GOVERNMENT WARNING", "GOVERNMENT WARNING"),
    (44, "Exact warning wording", "needs_review", "Only one statement found; both (1) and (2) required. Missing: statement (1).", "GOVERNMENT WARNING: (2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.", WHOLE),
    (45, "GOVERNMENT WARNING in caps", "pass", "GOVERNMENT WARNING appears in required form.", "GOVERNMENT WARNING", "GOVERNMENT WARNING"),
    (45, "Exact warning wording", "needs_review", "Warning text may not match required wording exactly.", "GOVERNMENT WARNING: this text speaks of something else altogether, at length", WHOLE),
    (46, "GOVERNMENT WARNING in caps", "pass", "GOVERNMENT WARNING appears in required form.", "GOVERNMENT WARNING", "GOVERNMENT WARNING"),
    (46, "Exact warning wording", "needs_review", "Only one statement found; both (1) and (2) required. Missing: statement (2).", WHOLE, WHOLE),
    (47, "GOVERNMENT WARNING in caps", "pass", "GOVERNMENT WARNING appears in required form.", "GOVERNMENT WARNING", "GOVERNMENT WARNING"),
    (47, "Exact warning wording", "pass", "Warning statement present and appears complete.", "GOVERNMENT WARNING: (1) According to the Surgeon General women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery and may cause health problems.", WHOLE),
    (48, "GOVERNMENT WARNING in caps", "pass", "GOVERNMENT WARNING appears in required form.", "GOVERNMENT WARNING", "GOVERNMENT WARNING"),
    (48, "Exact warning wording", "pass", "All required words present, no extra words, Surgeon General capitalized.", "Birth health defects problems GOVERNMENT WARNING: (1) According to the Surgeon General, should women not drink alcoholic beverages during pregnancy because of the risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.", WHOLE),
    (49, "Bottler/producer statement", "fail", "Bottler/producer name and address not found on label.", "", ""),
    (50, "Bottler/producer statement", "fail", "Bottler/producer name and address not found on label.", "", "Stone Bridge"),
    (51, "Bottler/producer statement", "pass", "Bottler/producer found on label (tokens in full text).", "", "Stone Bridge"),
    (52, "Bottler/producer statement", "needs_review", "Bottler same as brand (no separate bottler line); verify on label.", "", "Old Crow"),
    (53, "Bottler/producer statement", "needs_review", "Bottler/producer found on label — add to application for verification.", "Bottled by Crow Works, Frederick, MD", ""),
    (53, "Bottler address", "pass", "Bottler city/state found on label.", "Bottled by Crow Works, Frederick, MD", "Frederick, MD"),
    (54, "Bottler matches", "needs_review", "Bottler on label may not match application (fuzzy_ratio, 79%).", "abcdefghijkx", "abcdefghijklmnop"),
    (55, "Bottler/producer statement", "pass", "Bottler/producer found on label (tokens in full text).", "Qzwv, Reno, NV", "Stone Bridge"),
    (55, "Bottler address", "needs_review", "Bottler city 'Frederick', state 'MD' not found on label.", "Qzwv, Reno, NV", "Frederick, MD"),
    (56, "Bottler matches", "needs_review", "Bottler on label differs from application (20%).", "Qzwv, MD", "Stone Bridge"),
    (56, "Bottler address", "pass", "Bottler city/state found on label.", "Qzwv, MD", ", MD"),
    (57, "Bottler matches", "needs_review", "Bottler on label differs from application (50%) — likely OCR misread.", "ec", "ce"),
    (58, "Bottler/producer statement", "pass", "Bottler/producer matches (token_containment).", "Bottled by Crow Works, Frederick, MD", "Crow Works"),
    (58, "Bottler address", "pass", "Bottler city/state found on label.", "Bottled by Crow Works, Frederick, MD", "Frederick, MD"),
    (58, "Country of origin", "fail", "Imported product must show country of origin.", "", "France"),
    (59, "Bottler/producer statement", "pass", "Bottler/producer matches (token_containment).", "Bottled by Crow Works, Frederick, MD", "Crow Works"),
    (59, "Bottler address", "pass", "Bottler city/state found on label.", "Bottled by Crow Works, Frederick, MD", "Frederick, MD"),
    (59, "Country of origin matches", "needs_review", "Country on label 'lceland' differs from application 'Iceland' — likely OCR misread, verify manually.", "lceland", "Iceland"),
    (60, "Bottler/producer statement", "pass", "Bottler/producer matches (token_containment).", "Bottled by Crow Works, Frederick, MD", "Crow Works"),
    (60, "Bottler address", "pass", "Bottler city/state found on label.", "Bottled by Crow Works, Frederick, MD", "Frederick, MD"),
    (60, "Country of origin matches", "needs_review", "Country on label 'Peru' may not match application 'France'.", "Peru", "France"),
    (61, "Bottler/producer statement", "pass", "Bottler/producer matches (token_containment).", "Bottled by Crow Works, Frederick, MD", "Crow Works"),
    (61, "Bottler address", "pass", "Bottler city/state found on label.", "Bottled by Crow Works, Frederick, MD", "Frederick, MD"),
    (61, "Country of origin", "pass", "Country of origin found: SCOTLAND, UK.", "SCOTLAND, UK", "Scotland"),
    (62, "Bottler/producer statement", "pass", "Bottler/producer matches (token_containment).", "Bottled by Crow Works, Frederick, MD", "Crow Works"),
    (62, "Bottler address", "pass", "Bottler city/state found on label.", "Bottled by Crow Works, Frederick, MD", "Frederick, MD"),
    (62, "Country of origin", "pass", "Country of origin matches after OCR normalization: 15b050.", "15b050", "Isboso"),
    (63, "Bottler/producer statement", "pass", "Bottler/producer matches (token_containment).", "Bottled by Crow Works, Frederick, MD", "Crow Works"),
    (63, "Bottler address", "pass", "Bottler city/state found on label.", "Bottled by Crow Works, Frederick, MD", "Frederick, MD"),
    (63, "Country of origin", "needs_review", "Country of origin found on label — add to application for verification.", "Peru", ""),
    (64, "Sulfites statement", "pass", "Sulfites statement found.", "Contains Sulfites", "Required"),
    (65, "Sulfites statement", "fail", "Sulfites declaration required but not found.", "", "Required"),
    (66, "Sulfites statement", "fail", "Sulfites declaration required but not found.", "", "Required"),
    (67, "FD&C Yellow No. 5", "pass", "FD&C Yellow No. 5 statement found.", "Found", "Required"),
    (68, "FD&C Yellow No. 5", "fail", "FD&C Yellow No. 5 statement required but not found.", "", "Required"),
    (69, "Cochineal/Carmine statement", "pass", "Cochineal/Carmine declaration found.", "Found", "Required"),
    (70, "Cochineal/Carmine statement", "fail", "Cochineal/Carmine disclosure required but not found.", "", "Required"),
    (71, "Wood treatment", "pass", "Wood treatment statement found.", "Found", "Required"),
    (72, "Wood treatment", "fail", "Wood treatment statement required but not found.", "", "Required"),
    (74, "Age statement", "fail", "Age statement required but not found. (27 CFR 5.40(a): required for whisky aged < 4 years.)", "", "Required"),
    (75, "Age statement", "pass", "Age statement found.", "aged 3 years in oak", "Required"),
    (76, "Age statement", "fail", "Age statement required but not found.", "", "Required"),
    (79, "Age statement", "pass", "Age statement found.", "matured 2 years", "Required"),
    (80, "Age statement", "pass", "Age statement found. (27 CFR 5.40(a): required for whisky aged < 4 years.)", "age statement: none", "Required"),
    (81, "Age statement", "pass", "Age statement found.", "age  statement on the back", "Required"),
    (82, "Age statement", "fail", "Age statement required but not found.", "", "Required"),
    (83, "Neutral spirits / commodity", "pass", "Neutral spirits / commodity statement found.", "Found", "Required"),
    (84, "Neutral spirits / commodity", "fail", "Neutral spirits statement required but not found.", "", "Required"),
    (85, "Aspartame statement", "pass", "Aspartame statement found.", "Found", "Required"),
    (86, "Aspartame statement", "fail", "Aspartame statement required but not found.", "", "Required"),
    (88, "Sulfites statement", "pass", "Sulfites statement found.", "Contains Sulfites", "Required"),
    (88, "Appellation of origin", "pass", "Appellation of origin found.", "Found", "Required"),
    (89, "Sulfites statement", "pass", "Sulfites statement found.", "Contains Sulfites", "Required"),
    (89, "Appellation of origin", "needs_review", "Appellation of origin may be required. Verify.", "", "Required"),
    (90, "Sulfites statement", "pass", "Sulfites statement found.", "Contains Sulfites", "Required"),
    (90, "Varietal designation", "pass", "Varietal designation found: Red Wine.", "Red Wine", "Required"),
    (91, "Sulfites statement", "pass", "Sulfites statement found.", "Contains Sulfites", "Required"),
    (91, "Varietal designation", "needs_review", "Varietal designation expected but not detected.", "", "Required"),
]
