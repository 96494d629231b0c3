"""DuckDB SQL for the queries of the library's own operators, put together from named common table expressions."""

from __future__ import annotations

import re

from .config import Config
from .operators.blocking import band_slices, hash_parameters, layouts
from .operators.pairs import BRANDS

CFG = Config(n_hashes=24, rows=3, bands=8, seed=0)
Q = '"'


def _replace(x: str, *rewrites: tuple[str, str]) -> str:
    for a, b in rewrites:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def title_norm(x: str) -> str:
    return _replace(f"lower(coalesce({x}, ''))", (r'(\d+)\s*["”]', r"\1inch"), (r"\b(?:inches|inch)\b", "inch"), ("-inch", "inch"), (r"\b(?:hertz|hz)\b", "hz"), ("-hz", "hz"), (r"(\d+)\s*inch", r"\1inch"), (r"(\d+)\s*hz", r"\1hz"))


def value_norm(x: str) -> str:
    return _replace(
        f"lower(replace(coalesce({x}, ''), 'Â', ''))",
        (r"(\d),(\d)", r"\1.\2"), (r"(\d),(\d\d\d)\b", r"\1\2"), (r"\binches\b|\binch\b|\s*-inch\b|\s+inch\b", "inch"), (r"\bhertz\b|\bhz\b|\s+-hz\b|\s+hz\b", "hz"),
        (r"\bcd/?m2\b|\bcdm2\b|\bnits?\b", "nit"), (r"°|\bdegrees?\b|\bdeg\b", "deg"),
    )


def fractions(x: str) -> str:
    def one(pattern: str) -> str:
        g = lambda i: f"CAST(regexp_extract(m, '{pattern}', {i}) AS DOUBLE)"
        return f"list_transform(regexp_extract_all({x}, '{pattern}'), lambda m: {g(1)} + {g(2)} / CASE WHEN {g(3)} = 0 THEN 1.0 ELSE {g(3)} END)"

    return f"list_concat({one(r'(\d+)-(\d+)/(\d+)')}, {one(r'(\d+)\s+(\d+)/(\d+)')})"


def case(*values: str) -> str:
    return "CASE p_partkey % " + str(len(values)) + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


S = "CAST(p_size AS VARCHAR)"
PAIRS = [
    ("Brand", "p_brand"),
    ("Type", "p_type"),
    ("Screen Size", case(f"{S} || ' inch'", f"{S} || '\"'", f"{S} || ' inches'", f"{S} || '-inch'")),
    ("Refresh Rate", case("'60 hz'", "'120 hertz'", "'60-hz'")),
    ("Aspect Ratio", case("'16:9'", "'4 : 3'", "''")),
    ("Resolution", case("'1920 x 1080'", f"{S} || ' x 20 x 5 cm'", f"{S} || ' x 9'", "'1280x720 pixels'")),
    ("Width", case(f"{S} || '-7/8\"'", f"{S} || ' 1/2'", "'3-1/0'", f"'1,0' || {S}", f"{S} || ',5'")),
    ("Weight", case(f"{S} || 'kg'", f"{S} || ' lbs'", f"'Weight: ' || {S}")),
    ("Brightness", case("'450 nits'", "'450 cd/m2'", f"{S} || 'nit'")),
    ("Price", "CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)"),
]
TITLE = "p_name || ' ' || p_brand || ' ' || " + case(f"{S} || '\" LED 1080p'", f"{S} || '-inch TV 720p 60 Hz'", f"{S} || ' inches 120-hz & hdr'", f"'32.' || {S} || 'inch 16/9-'", f"{S} || ' cm or set 12-'")
NUMBER = r"^\d+(\.\d+)?$"
DIM = r"(\d+)\s*[xX×]\s*(\d+)(?:\s*[xX×]\s*(\d+))?"


def qgrams(x: str, q: int = 3) -> str:
    return f"CASE WHEN length({x}) >= {q} THEN list_distinct(list_transform(range(1, length({x}) - {q - 2}), lambda i: substring({x}, CAST(i AS INTEGER), {q}))) ELSE CAST([] AS VARCHAR[]) END"


def dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def cosine(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (sqrt(len({a})) + sqrt(len({b}))) END"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 1.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def label(n: str, c: str) -> str:
    word = lambda after, before=r"\b": f"regexp_matches({c}, '{before}' || {n} || '{after}')"
    has = lambda *words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    w = word(r"\b")
    rules = [
        ("res", word(r"p\b")), ("hz", word(r"\s*hz\b")), ("time", f"({word(r'\s*ms\b')} OR {has('response time', 'millisecond')})"), ("bright", f"{w} AND {has('nit', 'cd/m2', 'cd/m²', 'brightness')}"),
        ("weight", f"{w} AND {has('weight', 'lb', 'pound', 'kg')}"), ("power", f"{w} AND {has('watt', 'power consumption')}"), ("year", f"{w} AND {has('year')}"),
        ("inch", f"({word(r'\s*inch\b')} OR {word(r'\s*["”]', '')})"), ("mm", f"{w} AND {has('mm', 'millimeter', 'millimetre')}"), ("cm", f"{w} AND {has('cm', 'centimeter', 'centimetre')}"),
    ]
    return "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in rules) + " END"


def _params() -> str:
    ab, p = hash_parameters(CFG.n_hashes, 10, CFG.seed)
    return "VALUES " + ", ".join(f"({h}, {a}::BIGINT, {b}::BIGINT, {p}::BIGINT)" for h, (a, b) in enumerate(ab))


def _bands(rows: int, bands: int, sig: str = "sigs") -> str:
    return " UNION ALL ".join(f"SELECT pid, {i} AS band, sig[{at + 1}:{at + n}] AS k FROM {sig}" for i, (at, n) in enumerate(band_slices(CFG.n_hashes, rows, bands)))


def _metrics(pairs: str, products: str = "products") -> str:
    return f"""SELECT candidate_pairs, duplicates_found, pq, pc, CASE WHEN pq + pc = 0 THEN 0.0 ELSE 2 * pq * pc / (pq + pc) END AS f1_star, t FROM (
        SELECT candidate_pairs, duplicates_found, CASE WHEN candidate_pairs = 0 THEN 0.0 ELSE duplicates_found / candidate_pairs END AS pq,
          CASE WHEN candidate_pairs = 0 OR gold = 0 THEN 0.0 ELSE duplicates_found / gold END AS pc, CASE WHEN total = 0 THEN 0.0 ELSE candidate_pairs / total END AS t
        FROM (SELECT CAST(count(*) AS DOUBLE) AS candidate_pairs, CAST(coalesce(sum(CAST(a.model_id = b.model_id AS INTEGER)), 0) AS DOUBLE) AS duplicates_found
              FROM {pairs} p JOIN {products} a ON p.i = a.pid JOIN {products} b ON p.j = b.pid) x,
             (SELECT coalesce(sum(n * (n - 1) / 2.0), 0) AS gold FROM (SELECT count(*) AS n FROM {products} GROUP BY model_id) s) g,
             (SELECT count(*) * (count(*) - 1) / 2.0 AS total FROM {products}) t) y"""


#: name: SQL; a name in another's SQL is its dependency
CTE = {
    "products": f"SELECT p_partkey AS pid, p_name || '|' || p_brand AS model_id, p_type AS shop, {TITLE} AS title FROM part",
    "attributes": " UNION ALL ".join(f"SELECT p_partkey AS pid, {i} AS pos, '{k}' AS key, {v} AS value FROM part" for i, (k, v) in enumerate(PAIRS)),
    "title_runs": f"SELECT pid, unnest(list_distinct(regexp_extract_all({title_norm(title_norm('title'))}, '[a-z0-9_/''-]+'))) AS run FROM products",
    "title_trim": r"SELECT pid, run, regexp_replace(regexp_replace(run, '^[/''-]+', ''), '[/''-]+$', '') AS w, regexp_extract(run, '[/''-]*$') AS tail FROM title_runs",
    "title_words": r"SELECT DISTINCT pid, w AS token FROM title_trim WHERE regexp_matches(w, '\d') AND regexp_matches(w || tail, '[a-z_''-]') AND w <> ''",
    "title_tokens": r"SELECT pid, token FROM title_words WHERE regexp_matches(token, '\d') AND regexp_matches(token, '\D')",
    "value_texts": f"SELECT pid, pos, value, {value_norm('value')} AS norm, {fractions('value')} AS fractions FROM attributes WHERE value <> ''",
    "measurements": r"""SELECT DISTINCT pid, token FROM (SELECT pid, CAST(unnest(fractions) AS VARCHAR) AS token FROM value_texts
        UNION ALL SELECT pid, regexp_extract(norm, '^(\d+(?:\.\d+)?)[A-Za-z]*$', 1) AS token FROM value_texts WHERE regexp_matches(norm, '^\d+(\.\d+)?[A-Za-z]*$')) x""",
    "base_tokens": "SELECT pid, token FROM title_tokens UNION SELECT pid, token FROM measurements",
    "contexts": f"SELECT pid, -1 AS pos, 'title ' || {value_norm('title')} AS ctx FROM products UNION ALL SELECT pid, pos, norm AS ctx FROM value_texts",
    "ratio_pairs": r"SELECT DISTINCT pid, regexp_extract(m, '(\d+)\s*:\s*(\d+)', 1) AS a, regexp_extract(m, '(\d+)\s*:\s*(\d+)', 2) AS b FROM (SELECT pid, unnest(regexp_extract_all(ctx, '\d+\s*:\s*\d+')) AS m FROM contexts) x",
    "dim_groups": f"SELECT pid, ctx, m, list_filter([regexp_extract(m, '{DIM}', 1), regexp_extract(m, '{DIM}', 2), regexp_extract(m, '{DIM}', 3)], lambda n: n <> '') AS ns FROM (SELECT pid, lower(ctx) AS ctx, unnest(regexp_extract_all(ctx, '{DIM}')) AS m FROM contexts) x",
    "dim_units": """SELECT pid, ns, CASE WHEN contains(ctx, 'mm') OR contains(ctx, 'millimet') THEN 'mm' WHEN contains(ctx, 'cm') OR contains(ctx, 'centimet') THEN 'cm'
        WHEN contains(ctx, 'inch') OR contains(ctx, '"') THEN 'inch' WHEN contains(ctx, 'kg') OR contains(ctx, 'kilogram') OR contains(ctx, 'lb') THEN 'weight'
        WHEN list_max(list_transform(ns, lambda n: CAST(n AS DOUBLE))) >= 100 THEN 'res' END AS unit FROM dim_groups""",
    "dims": "SELECT DISTINCT pid, unnest(ns) AS n, unit FROM dim_units WHERE unit IS NOT NULL",
    "mixed": f"SELECT pid, token FROM base_tokens WHERE NOT regexp_matches(token, '{NUMBER}')",
    "suffixed": r"SELECT pid, regexp_extract(token, '^(\d+)', 1) AS n, CASE WHEN regexp_matches(token, '^\d+p$') THEN 'res' WHEN regexp_matches(token, '^\d+hz$') THEN 'hz' ELSE 'inch' END AS unit FROM mixed WHERE regexp_matches(token, '^\d+(p|hz|inch)$')",
    "used": "SELECT pid, a AS n FROM ratio_pairs UNION SELECT pid, b FROM ratio_pairs UNION SELECT pid, n FROM dims UNION SELECT pid, n FROM suffixed",
    "numbers": f"SELECT b.pid, b.token FROM base_tokens b WHERE regexp_matches(token, '{NUMBER}') AND NOT EXISTS (SELECT 1 FROM used u WHERE u.pid = b.pid AND u.n = b.token)",
    "near": rf"SELECT n.pid, n.token, c.pos, c.ctx, {fractions('c.ctx')} AS fr FROM numbers n JOIN contexts c ON n.pid = c.pid AND regexp_matches(c.ctx, '(^|\D)' || replace(n.token, '.', '\.') || '(\D|$)')",
    "rounded": "SELECT n.pid, n.token, CAST(CAST(floor(coalesce(min_by(e.fr[1], e.pos) FILTER (WHERE len(e.fr) > 0), CAST(n.token AS DOUBLE)) + 0.5) AS BIGINT) AS VARCHAR) AS r FROM numbers n LEFT JOIN near e ON e.pid = n.pid AND e.token = n.token GROUP BY n.pid, n.token",
    "labels": f"SELECT r.pid, r.token, r.r, coalesce(min_by({label('r.r', 'e.ctx')}, e.pos) FILTER (WHERE {label('r.r', 'e.ctx')} IS NOT NULL), 'int') AS label FROM rounded r LEFT JOIN near e ON e.pid = r.pid AND e.token = r.token GROUP BY r.pid, r.token, r.r",
    "typed_tokens": r"""SELECT pid, a || ':' || b || '_ratio' AS token FROM ratio_pairs UNION SELECT pid, CAST(CAST(n AS BIGINT) AS VARCHAR) || '_' || unit FROM dims UNION SELECT pid, token FROM mixed
        UNION SELECT pid, CAST(CAST(n AS BIGINT) AS VARCHAR) || '_' || unit FROM suffixed UNION SELECT pid, r || '_' || label FROM labels""",
    "combined_tokens": "SELECT pid, token FROM typed_tokens UNION SELECT pid, token FROM numbers",
    "df": "SELECT token, count(*) AS df FROM base_tokens GROUP BY token",
    "vocab": "SELECT token, row_number() OVER (ORDER BY first_pid, token) - 1 AS fid FROM (SELECT token, min(pid) AS first_pid FROM base_tokens GROUP BY token) x",
    "fids": "SELECT b.pid, v.fid FROM base_tokens b JOIN vocab v USING (token)",
    "params": f"SELECT * FROM ({_params()}) AS t(h, a, b, p)",
    "minima": "SELECT p.pid, q.h, coalesce(min((q.a * f.fid + q.b) % q.p), 9223372036854775807) AS m FROM products p CROSS JOIN params q LEFT JOIN fids f ON f.pid = p.pid GROUP BY p.pid, q.h",
    "sigs": "SELECT pid, list(m ORDER BY h) AS sig FROM minima GROUP BY pid",
    "bands": _bands(CFG.rows, CFG.bands),
    "bands_plus": _bands(5, 5),
    "cands": "SELECT DISTINCT a.pid AS i, b.pid AS j FROM bands a JOIN bands b ON a.band = b.band AND a.k = b.k AND a.pid < b.pid",
    "cands_plus": "SELECT DISTINCT a.pid AS i, b.pid AS j FROM bands_plus a JOIN bands_plus b ON a.band = b.band AND a.k = b.k AND a.pid < b.pid",
    "hay": "SELECT p.pid, lower(p.title || ' ' || string_agg(a.value, ' ' ORDER BY a.pos)) AS hay FROM products p JOIN attributes a USING (pid) GROUP BY p.pid, p.title",
    "masks": "SELECT pid, list_filter([" + ", ".join(f"'{b}'" for b in BRANDS) + "], lambda b: contains(hay, b)) AS mask FROM hay",
    "comparable": "SELECT c.i, c.j FROM cands c JOIN products a ON c.i = a.pid JOIN products b ON c.j = b.pid JOIN masks ma ON ma.pid = c.i JOIN masks mb ON mb.pid = c.j WHERE a.shop <> b.shop AND ma.mask = mb.mask",
    "grams": f"SELECT pid, pos, key, value, {qgrams('key')} AS kg, {qgrams('value')} AS vg, list_distinct(regexp_extract_all(value, '[A-Za-z0-9]*\\d+[A-Za-z0-9]*')) AS words FROM attributes",
    "key_pairs": f"SELECT ka, kb, {dice('ga', 'gb')} AS key_sim FROM (SELECT a.key AS ka, b.key AS kb, a.kg AS ga, b.kg AS gb FROM (SELECT DISTINCT key, kg FROM grams) a CROSS JOIN (SELECT DISTINCT key, kg FROM grams) b) x",
    "matches": f"SELECT c.i, c.j, a.pos AS pi, b.pos AS pj, k.key_sim, {dice('a.vg', 'b.vg')} AS val_sim FROM comparable c JOIN grams a ON a.pid = c.i JOIN key_pairs k ON k.ka = a.key AND k.key_sim > {CFG.gamma} JOIN grams b ON b.pid = c.j AND b.key = k.kb",
    "match_sums": "SELECT c.i, c.j, count(m.pi) AS n_matches, coalesce(sum(m.key_sim * m.val_sim) / nullif(sum(m.key_sim), 0), 0.0) AS avg_sim FROM comparable c LEFT JOIN matches m ON m.i = c.i AND m.j = c.j GROUP BY c.i, c.j",
    "rest_i": "SELECT c.i, c.j, list_distinct(flatten(list(g.words))) AS w FROM comparable c JOIN grams g ON g.pid = c.i WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.i = c.i AND m.j = c.j AND m.pi = g.pos) GROUP BY c.i, c.j",
    "rest_j": "SELECT c.i, c.j, list_distinct(flatten(list(g.words))) AS w FROM comparable c JOIN grams g ON g.pid = c.j WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.i = c.i AND m.j = c.j AND m.pj = g.pos) GROUP BY c.i, c.j",
    "bags": r"SELECT pid, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[&/-]', ' ', 'g'), '\s+'), lambda w: w NOT IN ('', 'and', 'or'))) AS bag, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]*\d+[a-z0-9]*')) AS models FROM products",
    "title_sims": f"SELECT c.i, c.j, CASE WHEN {cosine('a.bag', 'b.bag')} > {CFG.alpha} THEN 1.0 WHEN {cosine('a.models', 'b.models')} > 0 THEN {cosine('a.models', 'b.models')} ELSE -1.0 END AS title_sim FROM comparable c JOIN bags a ON a.pid = c.i JOIN bags b ON b.pid = c.j",
    "hybrid": f"""SELECT m.i, m.j, m.n_matches, m.avg_sim, {jaccard("coalesce(x.w, CAST([] AS VARCHAR[]))", "coalesce(y.w, CAST([] AS VARCHAR[]))")} AS model_sim, t.title_sim FROM match_sums m LEFT JOIN rest_i x ON x.i = m.i AND x.j = m.j LEFT JOIN rest_j y ON y.i = m.i AND y.j = m.j JOIN title_sims t ON t.i = m.i AND t.j = m.j""",
}
CLUSTERED = f"SELECT vec_id AS pid, label AS cluster_id, CAST(vec_id % 7 AS VARCHAR) AS model_id FROM embeddings"  # noqa: F541
CLUSTER_SQL = """SELECT CASE WHEN same = 0 THEN 0.0 ELSE tp / same END AS "precision", CASE WHEN gold = 0 THEN 0.0 ELSE tp / gold END AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (same + gold) END AS f1,
    tp AS "TP", same - tp AS "FP", total - same - gold + tp AS "TN", gold - tp AS "FN" FROM
    (SELECT sum(n * (n - 1) / 2.0) AS tp FROM (SELECT count(*) AS n FROM c GROUP BY cluster_id, model_id) x) a, (SELECT sum(n * (n - 1) / 2.0) AS same FROM (SELECT count(*) AS n FROM c GROUP BY cluster_id) x) b,
    (SELECT sum(n * (n - 1) / 2.0) AS gold FROM (SELECT count(*) AS n FROM c GROUP BY model_id) x) g, (SELECT count(*) * (count(*) - 1) / 2.0 AS total FROM c) t"""
CURVE = "SELECT p_type AS variant, CAST(p_size AS DOUBLE) / 50 AS x, avg(p_retailprice) / 2000 AS y FROM part GROUP BY p_type, p_size"
AREA = "SELECT variant, coalesce(sum(step), 0.0) AS auc FROM (SELECT variant, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS step FROM curve WINDOW w AS (PARTITION BY variant ORDER BY x, y)) s GROUP BY variant"


def with_ctes(select: str, **more: str) -> str:
    """select with the expressions it needs before it."""
    every, needed = CTE | more, []

    def need(sql: str) -> None:
        for name in every:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) and name not in needed:
                need(every[name])
                if name not in needed:
                    needed.append(name)

    need(select)
    return ("WITH " + ",\n".join(f"{n} AS ({every[n]})" for n in needed) + "\n" if needed else "") + select


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_GRID = " UNION ALL ".join(f"SELECT {r} AS r, {b} AS b, m.* FROM ({_metrics(f'g{r}_{b}')}) m" for r, b in layouts(CFG.n_hashes))
_GRID_CTES = {f"h{r}_{b}": _bands(r, b) for r, b in layouts(CFG.n_hashes)} | {f"g{r}_{b}": f"SELECT DISTINCT a.pid AS i, b.pid AS j FROM h{r}_{b} a JOIN h{r}_{b} b ON a.band = b.band AND a.k = b.k AND a.pid < b.pid" for r, b in layouts(CFG.n_hashes)}

SQL = {
    "normalize_units_title": f"SELECT p_partkey AS pid, {title_norm(TITLE)} AS text FROM part",
    "normalize_units_value": with_ctes("SELECT pid, pos, norm AS text FROM value_texts"),
    "title_model_words": with_ctes("SELECT pid, string_agg(token, ' ' ORDER BY token) AS words FROM title_words GROUP BY pid"),
    "fraction_values": with_ctes("SELECT pid, pos, unnest(fractions) AS value FROM value_texts"),
    "measurement_tokens": with_ctes("SELECT pid, token FROM measurements"),
    "first_numbers": with_ctes(r"SELECT pid, pos, CAST(nullif(regexp_extract(value, '[-+]?\d*\.?\d+'), '') AS DOUBLE) AS number FROM value_texts"),
    "base_tokens": with_ctes("SELECT pid, token FROM base_tokens"),
    "token_document_frequency": with_ctes("SELECT token, df FROM df"),
    "min_df_filter": with_ctes("SELECT b.pid, b.token FROM base_tokens b JOIN df USING (token) WHERE df >= 40"),
    "ratio_tokens": with_ctes("SELECT DISTINCT pid, a || ':' || b || '_ratio' AS token FROM ratio_pairs"),
    "dimension_tokens": with_ctes("SELECT DISTINCT pid, n, unit FROM dims"),
    "mixed_tokens": with_ctes("SELECT pid, n, unit FROM suffixed"),
    "numeric_labels": with_ctes("SELECT pid, token, r AS rounded, label FROM labels"),
    "typed_tokens": with_ctes("SELECT pid, token FROM typed_tokens"),
    "combined_tokens": with_ctes("SELECT pid, token FROM combined_tokens"),
    "vocabulary_ids": with_ctes("SELECT token, fid FROM vocab"),
    "feature_sets": with_ctes("SELECT p.pid, coalesce(string_agg(CAST(fid AS VARCHAR), ',' ORDER BY fid), '') AS fids FROM products p LEFT JOIN fids f USING (pid) GROUP BY p.pid"),
    "minhash_signatures": with_ctes("SELECT pid, h, m AS value FROM minima"),
    "lsh_exact": with_ctes("SELECT i, j FROM cands"),
    "token_dump": with_ctes("SELECT p.pid AS index, model_id, shop, title, coalesce(t.tokens, '') AS tokens FROM products p LEFT JOIN (SELECT pid, string_agg(token, ' ' ORDER BY token) AS tokens FROM base_tokens GROUP BY pid) t USING (pid)"),
    "no_attributes_guard": with_ctes("SELECT i, j FROM comparable WHERE i % 3 <> 0 AND j % 3 <> 0"),
    "all_pairs_partners": with_ctes("SELECT i, partners FROM (SELECT pid AS i, count(*) OVER () - row_number() OVER (ORDER BY pid) AS partners FROM products) x WHERE partners > 0"),
    "vocabulary_size": with_ctes("SELECT greatest(count(*), 1) AS size FROM vocab"),
    "catalogue_round_trip": "SELECT CAST(p_partkey AS VARCHAR) AS model_id, p_type AS shop, trim(p_name) AS title, '' AS url, '0=Brand=' || p_brand || ';1=Size=' || CAST(p_size AS VARCHAR) AS features FROM part",
    "results_round_trip": """SELECT p_type AS variant, CAST(p_size AS INTEGER) AS r, 1 AS b, count(*) / CAST(8 AS DOUBLE) AS t_lsh, count(*) * CAST(1000 AS DOUBLE) AS cand_pairs_lsh, CAST(count(*) AS DOUBLE) AS dup_lsh,
        CAST(max(p_size) AS DOUBLE) / 64 AS "PQ_lsh", CAST(count(*) AS DOUBLE) / 16 AS "PC_lsh", CAST(max(p_size) AS DOUBLE) / 4 AS "F1star_lsh", CAST(count(*) AS DOUBLE) AS "F1_clu", CAST(max(p_size) AS DOUBLE) AS "Prec_clu",
        CAST(count(*) * max(p_size) AS DOUBLE) AS "Rec_clu", round(count(*) * CAST(1000 AS DOUBLE) / CAST(187578 AS DOUBLE), 6) AS frac_comp FROM part GROUP BY p_type, p_size""",
    "lsh_plus_one": with_ctes("SELECT i, j FROM cands_plus"),
    "empty_set_collisions": "SELECT a.doc_id AS i, b.doc_id AS j FROM labels a JOIN labels b ON a.doc_id < b.doc_id WHERE a.toxic = 1 AND b.toxic = 1",
    "rb_layouts": "SELECT r, (840 + e) // r AS b FROM range(1, 841) t(r), (VALUES (0), (1)) x(e) WHERE (840 + e) % r = 0 AND (e = 0 OR r > 1)",
    "gold_pairs": with_ctes("SELECT a.pid AS i, b.pid AS j FROM products a JOIN products b ON a.model_id = b.model_id AND a.pid < b.pid"),
    "blocking_metrics": with_ctes(f"SELECT {r6('candidate_pairs', 'duplicates_found', 'pq', 'pc', 'f1_star', 't')} FROM ({_metrics('cands')}) m"),
    "blocking_grid": with_ctes(f"SELECT r, b, {r6('candidate_pairs', 'duplicates_found', 'pq', 'pc', 'f1_star', 't')} FROM ({_GRID}) m", **_GRID_CTES),
    "brand_mask_pairs": with_ctes("SELECT i, j FROM comparable"),
    "pair_filter_counts": with_ctes("SELECT (SELECT count(*) FROM cands) AS candidates, (SELECT count(*) FROM comparable) AS comparable"),
    "qgram_dice": with_ctes("SELECT ka AS key_a, kb AS key_b, round(key_sim, 6) AS similarity FROM key_pairs"),
    "set_jaccard": with_ctes(f"SELECT a.pid AS i, b.pid AS j, round({jaccard('a.bag', 'b.bag')}, 6) AS similarity FROM bags a JOIN bags b ON b.pid = a.pid + 1"),
    "root_sum_cosine": with_ctes(f"SELECT a.pid AS i, b.pid AS j, round({cosine('a.bag', 'b.bag')}, 6) AS similarity FROM bags a JOIN bags b ON b.pid = a.pid + 1"),
    "title_similarity": with_ctes("SELECT i, j, round(title_sim, 6) AS similarity FROM title_sims"),
    "attribute_matches": with_ctes("SELECT i, j, pi, pj, round(key_sim, 6) AS key_sim, round(val_sim, 6) AS val_sim FROM matches"),
    "hybrid_similarity": with_ctes(f"""SELECT i, j, n_matches, round(avg_sim, 6) AS avg_sim, round(model_sim, 6) AS model_sim, round(title_sim, 6) AS title_sim,
        round(1 - CASE WHEN title_sim < 0 THEN n_matches / 10.0 * avg_sim + (1 - n_matches / 10.0) * model_sim
          ELSE {1 - CFG.mu} * n_matches / 10.0 * avg_sim + ({1 - CFG.mu} - {1 - CFG.mu} * n_matches / 10.0) * model_sim + {CFG.mu} * title_sim END, 6) AS dist FROM hybrid"""),
    "cluster_metrics": f"WITH c AS ({CLUSTERED}) SELECT {r6('"precision"', 'recall', 'f1', '"TP"', '"FP"', '"TN"', '"FN"')} FROM ({CLUSTER_SQL}) m",
    "eps_selection": "SELECT p_brand AS k, arg_min(eps, (-f1, ord)) AS eps, max(f1) AS f1 FROM (SELECT p_brand, p_size / 100.0 AS eps, p_size AS ord, CAST(floor(p_retailprice / 100) AS DOUBLE) AS f1 FROM part) x GROUP BY p_brand",
    "grid_average": "SELECT p_size AS r, p_type AS b, round(avg(p_retailprice), 6) AS value FROM part GROUP BY p_size, p_type",
    "auc_trapezoid": f"WITH curve AS ({CURVE}) SELECT variant, round(auc, 6) AS auc FROM ({AREA}) a",
    "relative_auc": f"WITH curve AS ({CURVE}), a AS ({AREA}) SELECT variant, round(auc, 6) AS auc, round((auc - base) / base * 100, 6) AS gain FROM a, (SELECT auc AS base FROM a WHERE variant = 'ECONOMY') b",
    "json_flatten": "SELECT event_id, 0 AS pos, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events",
}
