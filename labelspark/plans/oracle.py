"""SQL that DuckDB runs over the same tables to check the registered queries.

The SQL is written apart from the Spark jobs: set-based, with self-joins and
ordered aggregates, and shares with them only fixed values (word lists, patterns).
"""

from __future__ import annotations

from labelspark import config as C
from labelspark.plans.fixtures import APPLICATIONS_SQL
from labelspark.plans.planted import CASES
from labelspark.plans.planted_results import PLANTED_RESULTS

REQUIRED = C.REQUIRED_STATEMENT
NEED = REQUIRED.upper().replace(",", "")
NEED_WORDS = sorted({w.strip(":.()") for w in NEED.split()})


def alternatives(values) -> str:
    return "|".join(sorted(values, key=len, reverse=True))


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


CLASS = rf"(?i)\b(?:{alternatives(C.CLASS_KEYWORDS)})\b"
CLASS_ANY = rf"(?i)(?:{alternatives(C.CLASS_KEYWORDS)})"
STRONG = rf"\b(?:{alternatives(C.STRONG_CLASS_WORDS)})\b"
KEYWORD = "|".join(C.WARNING_KEYWORDS)
SERVING = "|".join(C.SERVING_MARKERS)
SUFFIX = rf"(?:^|\s)({'|'.join(C.BRAND_SUFFIXES)})(?:\s|$)"
HEADER_ONLY = C.HEADER_ONLY.replace("'", "''")
BOTTLER = C.BOTTLER_HEADER.replace("'", "''")

APPS = f"apps AS ({APPLICATIONS_SQL})"
TYPED = f"""{APPS}, t AS (SELECT label_id, k,
 CASE WHEN contains(lower(beverage_type), 'wine') THEN 'wine' WHEN contains(lower(beverage_type), 'beer') THEN 'beer' ELSE 'spirits' END AS bev,
 brand_name AS a_brand, class_type AS a_class, alcohol_pct AS a_abv, proof AS a_proof, net_contents_ml AS a_net,
 bottler_name AS a_bottler, bottler_city AS a_city, bottler_state AS a_state, imported = 'true' AS imp, country_of_origin AS a_country
 FROM apps)"""
BLOCKS = f"""{TYPED}, raw AS (
 SELECT label_id,k,1 AS line_no, CASE WHEN k % 7 = 0 THEN replace(upper(brand_name),'O','0') ELSE upper(brand_name) END AS text FROM apps
 UNION ALL SELECT label_id,k,2, class_type FROM apps
 UNION ALL SELECT label_id,k,3, concat(cast(cast(alcohol_pct AS int) + CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END AS string), '% ALC/VOL', CASE WHEN proof <> '' THEN concat(' (', proof, ' PROOF)') ELSE '' END) FROM apps WHERE k % 19 <> 0
 UNION ALL SELECT label_id,k,4, CASE WHEN k % 23 = 0 THEN replace(net_contents_ml,'0','O') ELSE net_contents_ml END FROM apps
 UNION ALL SELECT label_id,k,5, concat('Bottled by ', bottler_name, ', Frederick, MD') FROM apps WHERE k % 17 <> 0
 UNION ALL SELECT label_id,k,6, 'Product of Scotland' FROM apps WHERE k % 8 = 0
 UNION ALL SELECT label_id,k,7, 'GOVERNMENT WARNING: (1) According to the Surgeon General,' FROM apps
 UNION ALL SELECT label_id,k,8, 'women should not drink alcoholic beverages during pregnancy because of the risk of birth defects.' FROM apps
 UNION ALL SELECT label_id,k,9, '(2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.' FROM apps WHERE k % 13 <> 0),
blocks AS (
 SELECT label_id, k, 0 AS pass_id, line_no, text, 10 AS x1, 40*line_no AS y1, 10 + 8*length(text) AS x2, 40*line_no + 28 AS y2, cast(90 - line_no AS double) AS confidence FROM raw
 UNION ALL SELECT label_id, k, 1, line_no, text, 12, 40*line_no+1, 12 + 8*length(text), 40*line_no+29, cast(80 - line_no AS double) FROM raw WHERE k % 5 = 0)"""
PAIRS = f"""{BLOCKS}, pairs AS (
 SELECT a.label_id, a.pass_id*100 + a.line_no AS block_a, b.pass_id*100 + b.line_no AS block_b,
  a.confidence AS conf_a, b.confidence AS conf_b, length(a.text) AS len_a, length(b.text) AS len_b, a.text AS text_a, b.text AS text_b,
  cast(greatest(0, least(a.x2,b.x2) - greatest(a.x1,b.x1)) * greatest(0, least(a.y2,b.y2) - greatest(a.y1,b.y1)) AS double)
   / least((a.x2-a.x1)*(a.y2-a.y1), (b.x2-b.x1)*(b.y2-b.y1)) AS overlap
 FROM blocks a JOIN blocks b ON a.label_id = b.label_id AND a.pass_id*100 + a.line_no < b.pass_id*100 + b.line_no)"""
# Suppression never chains here: a block only meets its copy from the other pass.
KEPT = f"""{PAIRS}, kept AS (
 SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY confidence DESC, pass_id, line_no) - 1 AS block_id
 FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.label_id = b.label_id AND p.block_b = b.pass_id*100 + b.line_no
  AND p.conf_a >= p.conf_b AND p.overlap > 0.4 AND p.len_b <= p.len_a)),
o AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY y1, x1, block_id) AS place FROM kept),
labels AS (SELECT label_id, string_agg(text, ' ' ORDER BY block_id) AS all_text, string_agg(text, ' ' ORDER BY place) AS combined FROM o GROUP BY 1)"""

# per-block tests of the reading-order table
FLAGS = rf"""{KEPT}, f AS (SELECT o.*,
 length(text) <= 1 OR length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) < 0.4 * length(text)
  OR regexp_matches(text, '{HEADER_ONLY}') OR upper(text) IN ({quoted(C.WARNING_WORDS + C.STOP_WORDS)}) AS junk,
 regexp_matches(text, '{C.ABV_QUALIFIED}') OR regexp_matches(text, '{BOTTLER}') OR contains(upper(text), 'IMPORTED BY')
  OR regexp_matches(text, '{C.NET_CONTENTS}') OR regexp_matches(text, '{C.COUNTRY_PHRASE}') OR starts_with(upper(text), 'CONTAINS')
  OR (regexp_matches(text, '{C.CITY_STATE}') AND NOT regexp_matches(text, '{CLASS_ANY}')) AS stop,
 regexp_matches(text, '{CLASS}') AS class_word,
 regexp_matches(upper(text), '{STRONG}') AS strong,
 len(list_distinct(regexp_extract_all(upper(text), '\w+'))) AS n_words,
 regexp_matches(upper(text), '{SERVING}') AND NOT regexp_matches(upper(text), '{KEYWORD}') AS serving_only,
 contains(upper(text), 'GOVERNMENT') AND contains(upper(text), 'WARNING') AS opens,
 regexp_matches(text, '{BOTTLER}') AS bottler_header,
 coalesce(nullif(regexp_extract(text, '{C.ABV_STRICT}', 1), ''), regexp_extract(text, '{C.ABV_QUALIFIED}', 1)) AS abv,
 regexp_extract(text, '{C.PROOF}', 1) AS proof_no,
 regexp_extract(text, '{C.NET_CONTENTS}', 1) AS net_no, lower(regexp_extract(text, '{C.NET_CONTENTS}', 2)) AS net_unit,
 regexp_extract(upper(text), '{SUFFIX}', 1) AS suffix,
 regexp_extract(text, '(?i)Product\s+of\s+(.+)', 1) AS country,
 regexp_matches(upper(text), '{KEYWORD}') AND NOT starts_with(upper(text), 'CONTAINS')
  AND NOT ((regexp_matches(text, '{C.NET_CONTENTS}') OR regexp_matches(text, '{C.ABV_QUALIFIED}')) AND NOT contains(upper(text), 'GOVERNMENT')) AS in_warning,
 concat_ws(',', x1, y1, x2, y2) AS box
 FROM o),
g AS (SELECT f.*, class_word AND NOT stop AND (strong OR n_words > 3) AS anchor,
 CASE WHEN in_warning THEN strpos(upper('{REQUIRED}'), trim(upper(left(text, 60)))) - 1 END AS warning_pos,
 CASE WHEN abv <> '' THEN CASE WHEN cast(abv AS double) BETWEEN 3 AND 75 THEN 2 ELSE 1 END + CASE WHEN regexp_matches(upper(text), 'ALC|VOL|PROOF') THEN 2 ELSE 0 END END AS abv_score
 FROM f)"""

# one row per label with all fields
FIELDS = rf"""{FLAGS},
brand AS (SELECT label_id, arg_min(trim(left(text, strpos(upper(text), suffix) - 1 + length(suffix))), place) AS v, arg_min(box, place) AS b FROM g WHERE suffix <> '' GROUP BY 1),
class AS (SELECT label_id, arg_min(text, place) AS v, arg_min(box, place) AS b FROM g WHERE anchor GROUP BY 1),
abv AS (SELECT label_id, arg_max(abv, abv_score * 1000 - place) AS v, arg_max(box, abv_score * 1000 - place) AS b FROM g WHERE abv <> '' GROUP BY 1),
proof AS (SELECT label_id, arg_min(proof_no, place) AS v, arg_min(box, place) AS b FROM g WHERE proof_no <> '' GROUP BY 1),
net AS (SELECT label_id, arg_min(concat(net_no, ' ', CASE WHEN net_unit = 'l' THEN 'L' WHEN contains(net_unit, 'fl') THEN 'fl oz' ELSE 'mL' END), place) AS v, arg_min(box, place) AS b FROM g WHERE net_no <> '' GROUP BY 1),
head AS (SELECT label_id, arg_min(x1, place) AS hx1, arg_min(x2, place) AS hx2 FROM g WHERE opens GROUP BY 1),
warning AS (SELECT g.label_id, string_agg(text, ' ' ORDER BY warning_pos, (y1+y2)/2.0, place) AS v,
  concat_ws(',', min(x1), min(y1), max(x2), max(y2)) AS b
  FROM g LEFT JOIN head h ON h.label_id = g.label_id
  WHERE in_warning AND (hx1 IS NULL OR (x1+x2)/2.0 BETWEEN hx1 - 30 AND hx2 + 50) GROUP BY 1),
bottled AS (SELECT label_id, arg_min(text, place) AS v, arg_min(box, place) AS b FROM g WHERE bottler_header GROUP BY 1),
sealed AS (SELECT label_id, arg_min(text, place) AS v, arg_min(box, place) AS b FROM g WHERE regexp_matches(upper(text), 'DSP|DISTILLERY') AND NOT opens AND length(text) >= 4 GROUP BY 1),
bottler AS (SELECT l.label_id, coalesce(x.v, s.v) AS v, coalesce(x.b, s.b) AS b FROM labels l LEFT JOIN bottled x USING (label_id) LEFT JOIN sealed s USING (label_id)),
country AS (SELECT label_id, arg_min(country, place) AS v, arg_min(box, place) AS b FROM g WHERE country <> '' GROUP BY 1),
fields AS (SELECT l.label_id, l.all_text, coalesce(brand.v,'') AS brand_name, brand.b AS brand_box, coalesce(class.v,'') AS class_type, class.b AS class_box,
  coalesce(abv.v,'') AS alcohol_pct, abv.b AS abv_box, coalesce(proof.v,'') AS proof, proof.b AS proof_box, coalesce(net.v,'') AS net_contents, net.b AS net_box,
  coalesce(warning.v,'') AS government_warning, warning.b AS warning_box, coalesce(bottler.v,'') AS bottler, bottler.b AS bottler_box,
  coalesce(country.v,'') AS country_of_origin, country.b AS country_box
 FROM labels l LEFT JOIN brand USING (label_id) LEFT JOIN class USING (label_id) LEFT JOIN abv USING (label_id) LEFT JOIN proof USING (label_id)
 LEFT JOIN net USING (label_id) LEFT JOIN warning USING (label_id) LEFT JOIN bottler USING (label_id) LEFT JOIN country USING (label_id))"""

ML = r"""CAST(round_even(CASE WHEN regexp_matches(lower({0}), 'ml$') THEN cast(regexp_extract({0}, '^([0-9.]+)', 1) AS double)
 WHEN regexp_matches(lower({0}), ' l$') THEN 1000 * cast(regexp_extract({0}, '^([0-9.]+)', 1) AS double)
 WHEN regexp_matches(lower({0}), 'oz$') THEN 29.5735 * cast(regexp_extract({0}, '^([0-9.]+)', 1) AS double) END, 0) AS BIGINT)"""

# results of all rules that these labels can meet; ids, texts and order as specified
FULL_OK = f"(contains(norm, '{NEED}') OR (length(norm) >= 50 AND starts_with('{NEED}', norm)))"
RULES = rf"""{FIELDS}, j AS (SELECT t.*, fields.* EXCLUDE (label_id), lower(all_text) AS low,
  translate(lower(a_brand), '1058', 'iosb') = translate(lower(brand_name), '1058', 'iosb') AS brand_same,
  {ML.format("a_net")} AS a_ml, {ML.format("net_contents")} AS l_ml,
  replace(upper(government_warning), ',', '') AS norm,
  contains(lower(bottler), lower(a_bottler)) AS bottler_in
 FROM t JOIN fields USING (label_id)),
rules AS (
 SELECT label_id, 1 AS n, 'Identity' AS category, 'Brand name matches' AS rule_id, CASE WHEN brand_same THEN 'pass' ELSE 'undecided' END AS status,
  concat('Brand name matches (', CASE WHEN lower(a_brand) = lower(brand_name) THEN 'exact' ELSE 'exact_ocr_normalized' END, ').') AS message, brand_name AS extracted_value, a_brand AS app_value FROM j
 UNION ALL SELECT label_id, 2, 'Identity', 'Class/type matches', CASE WHEN class_type = a_class THEN 'pass' ELSE 'undecided' END, 'Class/type matches (exact).', class_type, a_class FROM j
 UNION ALL SELECT label_id, 3, 'Alcohol & contents', CASE WHEN alcohol_pct = '' THEN 'Alcohol content present' ELSE 'Alcohol content matches' END,
  CASE WHEN alcohol_pct = '' THEN CASE WHEN bev = 'beer' THEN 'pass' ELSE 'fail' END WHEN abs(cast(alcohol_pct AS double) - cast(a_abv AS double)) <= 0.3 THEN 'pass' ELSE 'needs_review' END,
  CASE WHEN alcohol_pct = '' THEN CASE WHEN bev = 'beer' THEN 'Alcohol content not required for this beverage type.' ELSE 'Alcohol content (ABV) not found on label.' END
   WHEN abs(cast(alcohol_pct AS double) - cast(a_abv AS double)) <= 0.3 THEN 'Alcohol content present and matches.'
   ELSE concat('ABV on label (', alcohol_pct, '%) does not match application (', a_abv, '%).') END, alcohol_pct, a_abv FROM j
 UNION ALL SELECT label_id, 4, 'Alcohol & contents', CASE WHEN bev = 'spirits' AND proof = '' THEN 'Proof present' ELSE 'Proof' END,
  CASE WHEN bev = 'spirits' AND proof = '' THEN 'needs_review' ELSE 'pass' END,
  CASE WHEN bev <> 'spirits' THEN 'Proof not applicable for this beverage type.' WHEN proof = '' THEN 'Proof not found on label but specified in application.' ELSE 'Proof present and matches.' END, proof, a_proof FROM j
 UNION ALL SELECT label_id, 5, 'Alcohol & contents', 'Proof/ABV consistency', CASE WHEN abs(cast(proof AS double) - 2 * cast(alcohol_pct AS double)) > 1 THEN 'needs_review' ELSE 'pass' END,
  CASE WHEN abs(cast(proof AS double) - 2 * cast(alcohol_pct AS double)) > 1 THEN concat('Proof (', proof, ') does not equal 2× ABV (', alcohol_pct, '%). Expected proof ≈ ', cast(2 * cast(alcohol_pct AS int) AS varchar), '.') ELSE 'Proof and ABV are consistent (proof = 2 × ABV).' END,
  proof, CASE WHEN abs(cast(proof AS double) - 2 * cast(alcohol_pct AS double)) > 1 THEN 'proof = 2 × ABV' ELSE a_proof END FROM j WHERE proof <> '' AND alcohol_pct <> ''
 UNION ALL SELECT label_id, 6, 'Alcohol & contents', CASE WHEN net_contents = '' THEN 'Net contents present' WHEN bev <> 'beer' AND l_ml NOT IN {C.DEFAULT.standard_of_fill_ml} THEN 'Net contents standard of fill' ELSE 'Net contents' END,
  CASE WHEN net_contents = '' THEN 'fail' WHEN bev <> 'beer' AND l_ml NOT IN {C.DEFAULT.standard_of_fill_ml} THEN 'needs_review' ELSE 'pass' END,
  CASE WHEN net_contents = '' THEN 'Net contents not found on label.' WHEN bev <> 'beer' AND l_ml NOT IN {C.DEFAULT.standard_of_fill_ml} THEN concat('Net contents ''', net_contents, ''' is not a TTB authorized standard of fill.') ELSE concat('Net contents found: ', net_contents, '.') END, net_contents, a_net
  FROM j WHERE net_contents = '' OR (bev <> 'beer' AND l_ml NOT IN {C.DEFAULT.standard_of_fill_ml}) OR abs(a_ml - l_ml) <= 5
 UNION ALL SELECT label_id, 7, 'Alcohol & contents', 'Net contents matches', 'needs_review', concat('Net contents on label (', net_contents, ' ≈ ', l_ml, ' mL) does not match application (', a_net, ' ≈ ', a_ml, ' mL).'), net_contents, a_net FROM j WHERE net_contents <> '' AND abs(a_ml - l_ml) > 5
 UNION ALL SELECT label_id, 8, 'Warning', 'GOVERNMENT WARNING in caps', CASE WHEN contains(upper(government_warning), 'GOVERNMENT WARNING') THEN 'pass' ELSE 'fail' END, 'GOVERNMENT WARNING appears in required form.', 'GOVERNMENT WARNING', 'GOVERNMENT WARNING' FROM j
 UNION ALL SELECT label_id, 9, 'Warning', 'Exact warning wording', CASE WHEN {FULL_OK} THEN 'pass' ELSE 'undecided' END, 'Warning statement present and appears complete.', government_warning, '{REQUIRED}' FROM j
 UNION ALL SELECT label_id, 10, 'Origin', 'Bottler/producer statement', 'pass', CASE WHEN bottler = '' THEN 'Bottler/producer found on label (tokens in full text).'
   WHEN lower(bottler) = lower(a_bottler) THEN 'Bottler/producer matches (exact).'
   WHEN bottler_in THEN 'Bottler/producer matches (token_containment).' ELSE 'Bottler/producer matches (exact_ocr_normalized).' END, bottler, a_bottler FROM j
 UNION ALL SELECT label_id, 11, 'Origin', 'Bottler address', CASE WHEN contains(bottler, 'Frederick') THEN 'pass' ELSE 'needs_review' END,
  CASE WHEN contains(bottler, 'Frederick') THEN 'Bottler city/state found on label.' WHEN contains(lower(bottler), 'md') THEN 'Bottler city ''Frederick'' not found on label.' ELSE 'Bottler city ''Frederick'', state ''MD'' not found on label.' END, bottler, concat(a_city, ', ', a_state) FROM j WHERE bottler <> ''
 UNION ALL SELECT label_id, 12, 'Origin', 'Country of origin', CASE WHEN country_of_origin = '' THEN 'fail' ELSE 'pass' END,
  CASE WHEN country_of_origin = '' THEN 'Imported product must show country of origin.' ELSE concat('Country of origin found: ', country_of_origin, '.') END, country_of_origin, a_country FROM j WHERE imp
 UNION ALL SELECT label_id, 13, 'Other', 'Sulfites statement', CASE WHEN contains(low, 'sulfite') THEN 'pass' ELSE 'fail' END, 'Sulfites declaration required but not found.', '', 'Required' FROM j WHERE bev = 'wine'
 UNION ALL SELECT label_id, 14, 'Other', 'Age statement', 'fail', 'Age statement required but not found. (27 CFR 5.40(a): required for whisky aged < 4 years.)', '', 'Required' FROM j WHERE bev = 'spirits' AND regexp_matches(lower(a_class), 'whiskey|whisky') AND NOT regexp_matches(low, '\baged\b|\d+\s*years?\b')
 UNION ALL SELECT label_id, 15, 'Other', 'Neutral spirits / commodity', CASE WHEN regexp_matches(low, 'neutral spirits|grain spirits') THEN 'pass' ELSE 'fail' END, 'Neutral spirits statement required but not found.', '', 'Required' FROM j WHERE bev = 'spirits' AND a_class = 'Vodka')"""
STATUS = f"""{RULES}, s AS (SELECT label_id, count(*) FILTER (status = 'pass') AS pass_count, count(*) FILTER (status = 'needs_review') AS review_count, count(*) FILTER (status = 'fail') AS fail_count FROM rules GROUP BY 1),
status AS (SELECT label_id, CASE WHEN fail_count > 0 THEN 'Critical issues' WHEN review_count > 0 THEN 'Needs review' ELSE 'Ready to approve' END AS overall_status, pass_count, review_count, fail_count FROM s)"""

FILES = f"""{APPS}, files AS (
 SELECT concat('in/scans/', CASE WHEN k % 9 = 0 THEN lower(label_id) ELSE label_id END, '.png') AS path, 2*k AS listing_no, CASE WHEN k % 9 = 0 THEN lower(label_id) ELSE label_id END AS file_key FROM apps WHERE k % 10 <> 0
 UNION ALL SELECT concat('in/old.d/', label_id, '.jpg'), 2*k + CASE WHEN k % 10 <> 0 THEN 1 ELSE 0 END, label_id FROM apps WHERE k % 6 = 0)"""

# words of the block lines, one row each, and the far-off token of every sixth label
WORDS = f"""{BLOCKS}, split AS (SELECT b.*, string_split(text, ' ') AS ws FROM blocks b),
token AS (SELECT split.*, unnest(range(1, len(ws) + 1)) AS word_no FROM split),
words AS (
 SELECT label_id, pass_id, line_no AS line_num, word_no, ws[word_no] AS text, confidence AS conf,
  x1 + 8 * (CASE WHEN word_no = 1 THEN 0 ELSE length(array_to_string(ws[1:word_no-1], ' ')) + 1 END) AS "left", y1 AS top, 8 * length(ws[word_no]) AS width FROM token
 UNION ALL SELECT label_id, pass_id, line_no, 1000, 'LOT', confidence, x2 + 300, y1, 24 FROM blocks WHERE k % 6 = 0),
gaps AS (SELECT *, "left" - lag("left" + width) OVER w AS gap, lag(lower(text)) OVER w AS prev FROM words WINDOW w AS (PARTITION BY label_id, pass_id, line_num ORDER BY "left", word_no)),
cuts AS (SELECT label_id, pass_id, line_num, greatest(quantile_cont(gap, 0.75), 2 * quantile_cont(gap, 0.5), 18.0) AS threshold FROM gaps WHERE gap IS NOT NULL GROUP BY ALL),
subs AS (SELECT g.*, sum(CASE WHEN gap > threshold OR (regexp_matches(prev, '{"|".join(C.NUTRITION_SPLIT_WORDS)}') AND gap > 8) THEN 1 ELSE 0 END)
  OVER (PARTITION BY g.label_id, g.pass_id, g.line_num ORDER BY "left", word_no ROWS UNBOUNDED PRECEDING) AS sub_line
 FROM gaps g LEFT JOIN cuts c ON g.label_id = c.label_id AND g.pass_id = c.pass_id AND g.line_num = c.line_num)"""


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence (texts of at most 60 characters)."""
    full = f"((1::BIGINT << length({a})) - 1)"
    masks = (
        f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(1, length({a}) + 1), "
        f"lambda i: CASE WHEN substring({a}, i, 1) = c THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END))::BIGINT)"
    )
    fold = f"list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({fold}) END"


def ratio(a: str, b: str) -> str:
    return f"(2.0 * ({lcs(a, b)}) / (length({a}) + length({b})))"


SIMILAR = f"""{APPS}, lines AS (SELECT k - 1 AS k, CASE WHEN k % 7 = 0 THEN replace(upper(brand_name),'O','0') ELSE upper(brand_name) END AS line FROM apps),
p AS (SELECT label_id, lower(brand_name) AS a, lower(line) AS b FROM apps JOIN lines USING (k)),
tok AS (SELECT *, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb, translate(a, '1058', 'iosb') AS ao, translate(b, '1058', 'iosb') AS bo,
  array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb FROM p),
cross_tokens AS (SELECT label_id, i, unnest(tb) AS y, x FROM (SELECT label_id, tb, unnest(ta) AS x, unnest(range(len(ta))) AS i FROM tok)),
best AS (SELECT label_id, min(r) AS worst FROM (SELECT label_id, i, max({ratio("x", "y")}) AS r FROM cross_tokens GROUP BY 1, 2) GROUP BY 1),
scored AS (SELECT tok.*, worst, {ratio("a", "b")} AS whole, {ratio("sa", "sb")} AS sorted_words FROM tok JOIN best USING (label_id))
SELECT label_id, round(whole, 6) AS ratio,
 round(CASE WHEN a = b OR ao = bo THEN 1.0 WHEN list_has_all(tb, ta) OR list_has_all(string_split(bo, ' '), string_split(ao, ' ')) THEN 0.95
  WHEN list_has_all(ta, tb) OR list_has_all(string_split(ao, ' '), string_split(bo, ' ')) THEN 0.9 WHEN contains(a, b) OR contains(b, a) THEN 0.92
  WHEN worst >= 0.85 THEN greatest(0.88, 0.95 * worst) ELSE greatest(whole, sorted_words) END, 6) AS score,
 CASE WHEN a = b THEN 'exact' WHEN ao = bo THEN 'exact_ocr_normalized' WHEN list_has_all(tb, ta) THEN 'token_containment'
  WHEN list_has_all(string_split(bo, ' '), string_split(ao, ' ')) THEN 'token_containment_ocr_normalized'
  WHEN list_has_all(ta, tb) THEN 'reverse_containment' WHEN list_has_all(string_split(ao, ' '), string_split(bo, ' ')) THEN 'reverse_containment_ocr_normalized'
  WHEN contains(a, b) OR contains(b, a) THEN 'substring' WHEN worst >= 0.85 THEN 'fuzzy_token' ELSE 'fuzzy_ratio' END AS reason
FROM scored"""

SINGLE_PAIRS = [x + y for x, y in C.CONFUSABLE_PAIRS if len(x) == len(y) == 1]
SINGLE_PAIRS += [p[::-1] for p in SINGLE_PAIRS]
MISREAD = f"""WITH {APPS}, p AS (SELECT a.label_id, a.alcohol_pct AS a, lower(translate(b.alcohol_pct, '105', 'lOS')) AS b FROM apps a JOIN apps b ON b.k = a.k + 1),
q AS (SELECT *, length(a) - length(b) AS gap, list_filter(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: substring(a, i, 1) || substring(b, i, 1)), lambda s: s[1] <> s[2]) AS d FROM p)
SELECT label_id, CASE WHEN a = b THEN true WHEN abs(gap) <= 2 AND len(d) BETWEEN 1 AND 2 THEN list_has_all([{quoted(SINGLE_PAIRS)}], d)
 ELSE abs(gap) <= 3 AND {ratio("a", "b")} >= 0.65 END AS confusable FROM q"""

CRITERIA = ", ".join(
    f"({pos}, '{name}', '{rid}', {prio})"
    for pos, (name, ids) in enumerate(C.MATRIX_CRITERIA, 1)
    for prio, rid in enumerate(ids, 1)
)
MATRIX = rf"""{RULES}, crit(pos, criterion, rule_id, prio) AS (VALUES {CRITERIA}),
chosen AS (SELECT label_id, pos, criterion, arg_min(rules, prio) AS r FROM rules JOIN crit USING (rule_id) JOIN t USING (label_id)
  WHERE (criterion <> 'Country of Origin' OR imp) AND (criterion <> 'Proof' OR bev = 'spirits') GROUP BY 1, 2, 3),
shown AS (SELECT label_id, pos, criterion, r.app_value AS app, r.status AS status, r.extracted_value AS seen,
  r.rule_id = 'Bottler/producer statement' AND r.message LIKE '%(tokens in full text).' AS prefer FROM chosen),
swapped AS (SELECT *, CASE WHEN prefer AND app <> '' THEN app WHEN criterion NOT LIKE 'Government%' AND app <> '' AND seen <> ''
  AND NOT (regexp_matches(app, '^\d+(\.\d+)?%?\s*$') AND regexp_matches(seen, '^\d+(\.\d+)?%?\s*$')) AND length(seen) > length(app)
  AND list_bool_and(list_transform(string_split(lower(app), ' '), lambda w: contains(lower(seen), trim(w, '.,;:!?()')))) THEN app ELSE seen END AS lab FROM shown),
cutoff AS (SELECT *, CASE WHEN criterion <> 'Government Warning Wording' AND length(app) > 80 THEN left(app, 77) || '...' ELSE app END AS a2,
  CASE WHEN criterion <> 'Government Warning Wording' AND length(lab) > 80 THEN left(lab, 77) || '...' ELSE lab END AS l2 FROM swapped)
SELECT label_id, pos, criterion, CASE WHEN a2 = '' THEN '—' ELSE a2 END AS application, CASE WHEN l2 = '' THEN '—' ELSE l2 END AS label,
 CASE status WHEN 'pass' THEN 'Pass' WHEN 'fail' THEN 'Fail' ELSE 'Needs review' END AS status,
 CASE WHEN criterion = 'Government Warning Wording' THEN '' END AS unmatched FROM cutoff"""

LOG = """log AS (SELECT concat('L', user_id) AS label_id, ts, event_id AS entry_no,
 CASE WHEN event_type IN ('purchase', 'signup') THEN 'approve' WHEN event_type = 'error' THEN 'decline' ELSE 'undo' END AS decision FROM events),
current_state AS (SELECT label_id, decision, ts FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY ts DESC, entry_no DESC) AS rn FROM log) WHERE rn = 1 AND decision <> 'undo')"""


def repeats_sql() -> str:
    """Texts without adjacent repeats, by tables of words: one step for each phrase length and round.

    A step finds the places where `n` words, and the white space inside them, come twice in a row,
    goes through them from the left (recursively, each next one behind the second copy of the one
    before) and takes the second copies out.
    """
    word, space = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+", r"\s+"
    steps = [rf"""cleaned AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\|\s*', ' ', 'g'), '\}}\s*', ' ', 'g'), '[—\-]{{3,}}', ' ', 'g') AS text FROM documents),
 cut AS (SELECT doc_id, regexp_extract_all(text, '{word}') AS ws, regexp_split_to_array(text, '{word}') AS seps FROM cleaned),
 tok0 AS (SELECT doc_id, i AS pos, lower(ws[i]) AS w, ws[i] AS word, seps[i] AS sep FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM cut))"""]
    for k, n in enumerate([5, 4, 3, 2, 1] * 3, 1):
        inner = f"sum(cast(same_sep AS int)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {n - 1} FOLLOWING) = {n - 1}" if n > 1 else "true"
        steps.append(f"""a{k} AS MATERIALIZED (SELECT *, w = lead(w, {n}) OVER o AS same, sep = lead(sep, {n}) OVER o AND regexp_full_match(sep, '{space}') AS same_sep,
  regexp_full_match(lead(sep, {n}) OVER o, '{space}') AS joined FROM tok{k - 1} WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
 m{k} AS MATERIALIZED (SELECT doc_id, pos FROM (SELECT doc_id, pos, joined, {inner} AS inside,
  sum(cast(same AS int)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS alike FROM a{k}) WHERE alike = {n} AND joined AND inside),
 s{k} AS (SELECT doc_id, min(pos) AS pos FROM m{k} GROUP BY 1
  UNION ALL SELECT s.doc_id, min(m.pos) FROM s{k} s JOIN m{k} m ON m.doc_id = s.doc_id AND m.pos >= s.pos + {2 * n} GROUP BY s.doc_id, s.pos),
 gone{k} AS (SELECT doc_id, unnest(range(pos + {n}, pos + {2 * n})) AS pos FROM s{k}),
 tok{k} AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, w, word, sep FROM tok{k - 1} ANTI JOIN gone{k} USING (doc_id, pos))""")
    return f"""WITH RECURSIVE {", ".join(steps)},
 whole AS (SELECT doc_id, string_agg(concat(sep, word), '' ORDER BY pos) AS body FROM tok15 GROUP BY 1)
SELECT doc_id, trim(regexp_replace(concat(body, seps[-1]), '{space}', ' ', 'g')) AS text FROM cut LEFT JOIN whole USING (doc_id)"""


STATEMENTS = f"""{TYPED}, wordings(wording, text) AS (VALUES ('wine', '{REQUIRED} Contains sulfites.'), ('beer', '{REQUIRED} Contains fermented barley.'),
 ('spirits', '{REQUIRED} Distilled from selected grains.')),
s0 AS (SELECT label_id, k, wording, CASE WHEN k % 2 = 0 THEN upper(text) ELSE text END AS text FROM t JOIN wordings ON wording = bev)""" + "".join(
    f""",
s{i} AS (SELECT label_id, k, wording, CASE WHEN k % {every} = 0 THEN replace(text, '{old}', '{new}') ELSE text END AS text FROM s{i - 1})"""
    for i, (every, old, new) in enumerate([
        (3, "Surgeon", "Surge0n"), (4, "PREGNANCY", "PREGNANGY"), (5, "beverages", "bevverages"), (6, "MACHINERY", "MACHNERY"),
        (7, "problems", "porblems"), (8, "GOVERNMENT", "G0VERNMENTT"), (9, "health", "hea1th"), (10, "SULFITES", "SULPHITES"),
        (11, "operate", "xxerxte"), (12, "SHOULD", "SH0ULD"),
    ], 1)
) + r""",
planted AS (SELECT label_id, k, wording, concat(text, ' birt', k % 50) AS text FROM s10),
refs AS (SELECT DISTINCT wording, unnest(regexp_extract_all(upper(text), '\w+')) AS ref FROM wordings),
seen AS (SELECT DISTINCT wording, unnest(regexp_extract_all(upper(text), '\w+')) AS word FROM planted),
fixes AS (SELECT wording, word, arg_min(ref, (levenshtein(word, ref), ref)) AS replacement FROM (SELECT * FROM seen ANTI JOIN refs ON seen.wording = refs.wording AND seen.word = refs.ref) JOIN refs USING (wording)
 WHERE length(word) >= 4 AND length(ref) >= 5 AND levenshtein(word, ref) <= 2 GROUP BY 1, 2)"""


def planted_sql() -> str:
    rows = ", ".join(f"({case}, {quoted(texts)})" for case, *texts in PLANTED_RESULTS)
    about = ", ".join(f"({i}, '{category}')" for i, (category, *_) in enumerate(CASES))
    return f"""WITH expected(case_no, rule_id, status, message, extracted_value, app_value) AS (VALUES {rows}), about(case_no, category) AS (VALUES {about})
SELECT concat('L', p_partkey) AS label_id, p_partkey % {len(CASES)} AS case_no, rule_id, category, status, message, extracted_value, app_value,
 message LIKE '%(tokens in full text).' AS prefer_app_display FROM part JOIN expected e ON e.case_no = p_partkey % {len(CASES)} JOIN about a ON a.case_no = e.case_no"""


def rules_of(category: str) -> str:
    return f"""WITH {RULES} SELECT label_id, rule_id, status, message, extracted_value, app_value,
 message LIKE '%(tokens in full text).' AS prefer_app_display FROM rules WHERE category = '{category}'"""


def field(name: str, box: str) -> str:
    return f"WITH {FIELDS} SELECT label_id, {name} AS value, {box} AS bbox FROM fields"


STATUS_ROWS = f"WITH {STATUS} SELECT * FROM status"
COVERED = ", ".join(
    f"('{title}', {name})"
    for name, title in [
        ("brand_name", "Brand name"), ("class_type", "Class / type"), ("alcohol_pct", "ABV %"),
        ("proof", "Proof"), ("net_contents", "Net contents"), ("bottler", "Bottler"),
        ("government_warning", "Gov. warning"), ("country_of_origin", "Country of origin"),
    ]
)

ORACLE: dict[str, str] = {
    "applications_typed": f"""WITH {TYPED} SELECT label_id, bev AS beverage_type, a_brand AS brand_name, a_class AS class_type, a_abv AS alcohol_pct,
 a_proof AS proof, a_net AS net_contents_ml, a_bottler AS bottler_name, a_city AS bottler_city, a_state AS bottler_state, a_country AS country_of_origin,
 imp AS imported, false AS sulfites_required, false AS fd_c_yellow_5_required, false AS carmine_required, false AS wood_treatment_required,
 false AS age_statement_required, false AS neutral_spirits_required, CAST(k % 9 AS INT) AS age_years, false AS aspartame_required,
 false AS appellation_required, false AS varietal_required FROM t""",
    "label_file_index": f"WITH {FILES} SELECT path, listing_no, file_key FROM files",
    "label_file_match": f"""WITH {FILES}, hit AS (SELECT a.label_id, f.path, row_number() OVER (PARTITION BY a.label_id
  ORDER BY CASE WHEN f.file_key = a.label_id THEN 0 ELSE 1 END, f.listing_no) AS rn FROM apps a JOIN files f ON lower(a.label_id) = lower(f.file_key))
 SELECT label_id, path FROM hit WHERE rn = 1""",
    "missing_label_files": f"WITH {FILES} SELECT label_id, brand_name FROM apps WHERE lower(label_id) NOT IN (SELECT lower(file_key) FROM files)",
    "usable_ocr_words": f"WITH {WORDS} SELECT label_id, count(*) AS words, sum(length(text)) AS chars FROM words WHERE word_no % 5 <> 0 AND word_no % 7 <> 0 GROUP BY 1",
    "word_gaps": f"WITH {WORDS} SELECT label_id, pass_id, line_num, word_no, gap FROM gaps",
    "gap_thresholds": f"WITH {WORDS} SELECT label_id, pass_id, line_num, word_no, coalesce(threshold, 18.0) AS threshold FROM gaps LEFT JOIN cuts USING (label_id, pass_id, line_num)",
    "sub_lines": f"WITH {WORDS} SELECT label_id, pass_id, line_num, word_no, sub_line FROM subs",
    "line_blocks": f"""WITH {WORDS} SELECT label_id, pass_id, line_num, sub_line, string_agg(text, ' ' ORDER BY "left", word_no) AS text, min("left") AS x1, min(top) AS y1,
 max("left" + width) AS x2, max(top + 28) AS y2, avg(conf) AS confidence FROM subs GROUP BY 1, 2, 3, 4""",
    "deduplicated_blocks": f"WITH {KEPT} SELECT label_id, block_id, text, x1, y1, x2, y2, confidence FROM kept",
    "overlapping_blocks": f"WITH {PAIRS} SELECT label_id, block_a, block_b, round(overlap, 6) AS overlap FROM pairs WHERE overlap > 0.4",
    "reading_order": f"WITH {KEPT} SELECT label_id, place - 1 AS place, block_id, lag(text) OVER (PARTITION BY label_id ORDER BY place) AS previous_text FROM o",
    "label_text": f"WITH {KEPT} SELECT label_id, all_text FROM labels",
    "block_flags": f"""WITH {FLAGS} SELECT label_id, block_id, junk, stop, class_word, anchor, serving_only, opens, in_warning, bottler_header,
 coalesce(try_cast(nullif(abv, '') AS double) BETWEEN 3 AND 75, false) AS plausible FROM g""",
    "statement_order": f"WITH {FLAGS} SELECT label_id, block_id, warning_pos FROM g WHERE in_warning",
    "field_brand_name": field("brand_name", "brand_box"),
    "field_class_type": field("class_type", "class_box"),
    "field_alcohol_pct": field("alcohol_pct", "abv_box"),
    "field_proof": field("proof", "proof_box"),
    "field_net_contents": field("net_contents", "net_box"),
    "field_government_warning": field("government_warning", "warning_box"),
    "field_bottler": field("bottler", "bottler_box"),
    "field_country_of_origin": field("country_of_origin", "country_box"),
    "field_warning_by_anchor": f"""WITH {FLAGS}, head AS (SELECT label_id, min(place) AS start, arg_min(x1, place) AS hx1, arg_min(x2, place) AS hx2 FROM g WHERE opens GROUP BY 1)
 SELECT label_id, string_agg(text, ' ' ORDER BY place) AS value FROM g JOIN head USING (label_id)
 WHERE place >= start AND NOT stop AND x1 <= hx2 + greatest(0.3 * (hx2 - hx1), 30) AND x2 >= hx1 - greatest(0.3 * (hx2 - hx1), 30) GROUP BY 1""",
    "field_table": f"""WITH {FIELDS}, u AS (SELECT label_id, x.field AS field, x.v AS v FROM fields, LATERAL (VALUES {COVERED}) AS x(field, v))
 SELECT label_id, field, CASE WHEN v = '' THEN '(not found)' WHEN field = 'Gov. warning' THEN regexp_replace(v, '\\bsurgeon\\s+general\\b', 'Surgeon General', 'gi') ELSE v END AS extracted FROM u""",
    "field_coverage": f"""WITH {FIELDS}, u AS (SELECT x.field AS field, x.v AS v FROM fields, LATERAL (VALUES {COVERED}) AS x(field, v))
 SELECT field, count(*) AS labels, count(*) FILTER (v <> '') AS found FROM u GROUP BY 1""",
    "field_comparison": f"""WITH {FIELDS}, j AS (SELECT t.*, fields.* EXCLUDE (label_id) FROM t JOIN fields USING (label_id))
 SELECT label_id, 'brand_name' AS field, brand_name AS extracted, a_brand AS expected, CASE WHEN replace(upper(brand_name), ' ', '') = replace(upper(a_brand), ' ', '') OR contains(upper(brand_name), upper(a_brand)) THEN 'OK' ELSE 'DIFF' END AS verdict FROM j
 UNION ALL SELECT label_id, 'class_type', class_type, a_class, CASE WHEN contains(lower(class_type), lower(a_class)) OR contains(lower(a_class), lower(class_type)) THEN 'OK' ELSE 'DIFF' END FROM j
 UNION ALL SELECT label_id, 'alcohol_pct', alcohol_pct, a_abv, CASE WHEN alcohol_pct = a_abv THEN 'OK' ELSE 'DIFF' END FROM j
 UNION ALL SELECT label_id, 'net_contents', net_contents, a_net, CASE WHEN net_contents <> '' THEN 'OK' ELSE 'DIFF' END FROM j
 UNION ALL SELECT label_id, 'bottler', bottler, a_bottler, CASE WHEN bottler <> '' AND (contains(lower(bottler), lower(a_bottler)) OR contains(lower(a_bottler), lower(bottler))) THEN 'OK' ELSE 'DIFF' END FROM j
 UNION ALL SELECT label_id, 'government_warning', concat(length(government_warning), ' chars'), 'present (full text)', CASE WHEN length(government_warning) > 50 THEN 'OK' ELSE 'CHECK' END FROM j""",
    "rules_identity": rules_of("Identity"),
    "rules_alcohol": rules_of("Alcohol & contents"),
    "rules_warning": rules_of("Warning"),
    "rules_origin": rules_of("Origin"),
    "rules_other": rules_of("Other"),
    "class_requirements": f"""WITH {APPS} SELECT label_id, concat_ws(',', CASE WHEN contains(class_type, 'Scotch') THEN 'country_of_origin' END, CASE WHEN class_type = 'Vodka' THEN 'neutral_spirits' END,
 CASE WHEN regexp_matches(class_type, 'Straight (Bourbon|Rye|Wheat|Malt|Corn|Whisk)|Bourbon|Tennessee Whisk') THEN 'state_of_distillation' END) AS needs FROM apps""",
    "verify_labels": STATUS_ROWS,
    "verify_from_words": STATUS_ROWS,
    "score_rule_table": STATUS_ROWS,
    "result_matrix": f"WITH {MATRIX}",
    "critical_labels": f"WITH {STATUS} SELECT label_id, fail_count, a_brand AS brand_name, a_class AS class_type FROM status JOIN t USING (label_id) WHERE overall_status = 'Critical issues'",
    "batch_with_errors": f"""WITH {STATUS} SELECT label_id, CASE WHEN k % 29 = 0 THEN 'Critical issues' ELSE overall_status END AS overall_status,
 CASE WHEN k % 29 = 0 THEN 1 ELSE fail_count END AS fail_count, a_brand AS brand_name, a_class AS class_type, CASE WHEN k % 29 = 0 THEN 'unreadable' END AS error FROM status JOIN t USING (label_id)""",
    "batch_totals": f"WITH {STATUS} SELECT overall_status, count(*) AS labels, sum(fail_count) AS failed_rules FROM status GROUP BY 1",
    "parsed_contents": f"""WITH {APPS}, l AS (SELECT label_id, alcohol_pct, net_contents_ml AS app, CASE WHEN k % 23 = 0 THEN replace(net_contents_ml,'0','O') ELSE net_contents_ml END AS line FROM apps),
 m AS (SELECT *, regexp_replace(line, '^75O', '750') AS fixed FROM l)
 SELECT label_id, {ML.format("fixed")} AS label_ml, {ML.format("app")} AS app_ml, cast(alcohol_pct AS double) AS abv, translate(line, 'OoIlSB', '001158') AS digits FROM m""",
    "normalised_names": f"""WITH {BLOCKS} SELECT label_id, pass_id, line_no, concat(text, ' x') AS normed,
 array_to_string(list_filter(list_transform(string_split(lower(concat('(', text, '), ...')), ' '), lambda x: trim(x, '.,;:!?''"()')), lambda x: x <> ''), '|') AS tokens,
 translate(lower(text), '1058', 'iosb') AS folded, concat(upper(left(text, 1)), lower(substring(text, 2))) AS cased FROM blocks""",
    "name_similarity": f"WITH {SIMILAR}",
    "misread_numbers": MISREAD,
    "youngest_age": """WITH s AS (SELECT p_partkey, p_size, p_partkey % 37 AS other, concat('aged ', p_size, ' years, finished ', p_partkey % 37, ' year in oak') AS text FROM part)
 SELECT p_partkey, least(p_size, other) AS age, concat(left(text, 5 + length(cast(p_size AS varchar)) + 6), ', fin') AS snippet FROM s""",
    "statement_words": rf"""WITH {FIELDS}, n AS (SELECT label_id, replace(upper(government_warning), ',', '') AS normed, regexp_extract_all(upper(all_text), '\w+') AS label_words FROM fields),
 w AS (SELECT *, regexp_extract_all(normed, '\w+') AS ws FROM n)
 SELECT label_id, normed, len(list_filter([{quoted(NEED_WORDS)}], lambda q: len(list_filter(ws, lambda e: e = q OR (length(q) >= 5 AND length(e) >= 4 AND levenshtein(e, q) <= 2)))
   < len(list_filter(regexp_extract_all('{NEED}', '\w+'), lambda x: x = q)))) = 0 AS all_present,
  list_contains(ws[1:3], 'BIRTH') AS in_order,
  array_to_string(list_sort(list_distinct(list_filter(label_words, lambda e: NOT list_contains([{quoted(NEED_WORDS)}], e))))[1:5], ' ') AS extra FROM w""",
    "unknown_label_words": rf"""WITH {KEPT}, lexicon AS (SELECT DISTINCT upper(unnest(regexp_extract_all(concat_ws(' ', p_name, p_type), '\w+'))) AS word FROM part
  UNION SELECT unnest([{quoted(NEED_WORDS)}])),
 counted AS (SELECT label_id, word, count(*) AS n FROM (SELECT label_id, unnest(regexp_extract_all(upper(all_text), '\w+')) AS word FROM labels) GROUP BY 1, 2)
 SELECT label_id, word, n FROM counted WHERE length(word) >= 2 AND NOT regexp_matches(word, '^\d+$') AND word NOT IN (SELECT word FROM lexicon)""",
    "documents_with_passages": "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "document_words": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS word FROM documents),
 c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2)
 SELECT doc_id, sum(n) AS words, count(*) AS distinct_words, max(n) AS most_frequent FROM c GROUP BY 1""",
    "document_cleaning": r"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normed, regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]+') AS ws FROM documents),
 m AS (SELECT *, list_filter(ws, lambda w: regexp_full_match(w, '[A-Za-z]{2,}')) AS plain FROM n)
 SELECT doc_id, normed, len(list_filter(string_split(lower(normed), ' '), lambda w: trim(w, '.,;:!?''"()') <> '')) AS tokens,
 CASE WHEN len(list_filter(plain, lambda w: w = upper(w))) * 2 > len(plain) THEN 'upper' WHEN len(list_filter(plain, lambda w: w = lower(w))) * 2 > len(plain) THEN 'lower' ELSE 'mixed' END AS casing FROM m""",
    "order_totals": """WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS expected FROM lineitem GROUP BY 1),
 r AS (SELECT o_custkey, CASE WHEN expected IS NULL THEN 'fail' WHEN abs(o_totalprice - expected) > 1.0 THEN 'needs_review' ELSE 'pass' END AS status FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
 s AS (SELECT cast(c_custkey AS varchar) AS label_id, count(*) FILTER (status = 'pass') AS pass_count, count(*) FILTER (status = 'needs_review') AS review_count, count(*) FILTER (status = 'fail') AS fail_count
  FROM customer LEFT JOIN r ON c_custkey = o_custkey GROUP BY 1)
 SELECT *, CASE WHEN fail_count > 0 THEN 'Critical issues' WHEN review_count > 0 THEN 'Needs review' ELSE 'Ready to approve' END AS overall_status FROM s""",
    "stitched_conversations": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role) AS text, count(*) AS turns FROM conversations GROUP BY 1",
    "current_decisions": f"WITH {LOG} SELECT label_id, decision, ts FROM current_state",
    "decision_overlay": f"WITH {APPS}, {LOG} SELECT label_id, brand_name, decision FROM apps LEFT JOIN current_state USING (label_id)",
    "bucket_counts": f"""WITH {APPS}, {LOG}, u AS (SELECT coalesce(a.label_id, c.label_id) AS id, CASE c.decision WHEN 'approve' THEN 'approved' WHEN 'decline' THEN 'rejected' ELSE 'under_review' END AS bucket
  FROM apps a FULL JOIN current_state c ON a.label_id = c.label_id) SELECT bucket, count(*) AS applications FROM u GROUP BY 1""",
    "store_entries": f"WITH {TYPED} SELECT label_id AS id, base64(encode(a_brand)) AS encoded, a_brand AS decoded, a_abv AS alcohol_pct, imp AS imported, 0 AS age_years FROM t",
    "store_after_decisions": f"""WITH {TYPED}, {LOG}, l AS (SELECT label_id, arg_max(event_type, (ts, event_id)) AS kind FROM (SELECT *, concat('L', user_id) AS label_id FROM events) GROUP BY 1)
 SELECT coalesce(t.label_id, l.label_id) AS id, a_brand AS brand_name, a_class AS class_type,
  CASE WHEN t.label_id IS NULL THEN NULL WHEN k % 3 = 0 THEN 'Ready to approve' ELSE 'Needs review' END AS overall_status,
  CASE WHEN t.label_id IS NOT NULL THEN concat('{{"alcohol_pct":"', a_abv, '","imported":', imp, '}}') END AS app_data, a_net AS image_bytes,
  CASE WHEN t.label_id IS NOT NULL THEN concat('{{"pass_count":', k, '}}') END AS result,
  CASE WHEN kind IN ('purchase', 'signup') THEN 'approved' WHEN kind = 'error' THEN 'rejected' ELSE 'under_review' END AS bucket
 FROM t FULL JOIN l ON t.label_id = l.label_id""",
    "application_file_entries": f"""WITH {APPS} SELECT label_id AS id, CASE k % 3 WHEN 0 THEN 'under_review' WHEN 1 THEN 'approved' ELSE 'rejected' END AS bucket, brand_name,
 concat('{{"alcohol_pct":"', alcohol_pct, '","more":{{"proof":"', proof, '"}}}}') AS app_data, class_type AS image, concat('{{"note":', k % 5, '}}') AS extra
 FROM apps WHERE (k // 10) % 13 <> 5""",
    "submitted_csv": f"""WITH {TYPED} SELECT label_id, CASE WHEN k % 4 = 0 THEN concat(a_brand, chr(10), 'of "Old", Town', chr(10), a_class) ELSE a_brand END AS brand_name,
 a_class AS class_type, a_abv AS alcohol_pct, imp AS imported FROM t""",
    "document_repeats": repeats_sql(),
    "corrected_statement_words": f"WITH {STATEMENTS} SELECT wording, word, replacement FROM fixes",
    "corrected_statements": rf"""WITH {STATEMENTS}, pieces AS (SELECT label_id, wording, k, unnest(regexp_extract_all(text, '\w+|\W+')) AS piece, unnest(range(len(regexp_extract_all(text, '\w+|\W+')))) AS i FROM planted)
 SELECT label_id, string_agg(CASE WHEN replacement IS NULL THEN piece WHEN k % 2 = 0 THEN replacement ELSE lower(replacement) END, '' ORDER BY i) AS corrected
 FROM pieces p LEFT JOIN fixes f ON p.wording = f.wording AND upper(piece) = word GROUP BY 1""",
    "batch_rows": f"""WITH {STATUS} SELECT label_id, CASE WHEN k % 29 = 0 THEN 'Critical issues' ELSE overall_status END AS overall_status, CASE WHEN k % 29 = 0 THEN 1 ELSE fail_count END AS fail_count,
 a_brand AS brand_name, a_class AS class_type, CASE WHEN k % 29 = 0 THEN 'unreadable' END AS error, CASE WHEN k % 29 <> 0 THEN pass_count + review_count + fail_count END AS result_rules,
 CASE WHEN k % 29 <> 0 THEN overall_status END AS result_status, CASE WHEN k % 29 <> 0 THEN review_count END AS result_reviews,
 a_brand AS app_brand_name, a_abv AS app_alcohol_pct, CASE WHEN imp THEN 'true' ELSE 'false' END AS app_imported, a_city AS app_bottler_city FROM status JOIN t USING (label_id)""",
    "report_of_broken_words": f"""WITH {STATUS}, e AS (SELECT *, CASE WHEN k % 31 = 0 AND k % 19 <> 0 THEN 'word 1: left is not a number' WHEN k % 37 = 0 THEN 'word 1: width is missing' END AS bad FROM t)
 SELECT label_id, CASE WHEN bad IS NOT NULL THEN 'Critical issues' ELSE overall_status END AS overall_status, CASE WHEN bad IS NOT NULL THEN 1 ELSE fail_count END AS fail_count,
 a_brand AS brand_name, a_class AS class_type, bad AS error FROM status JOIN e USING (label_id)""",
    "rule_arms": planted_sql(),
}
