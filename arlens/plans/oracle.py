"""DuckDB oracles: for each Q-key an independent SQL formulation.

The fixtures are rebuilt in SQL from the same driver tables (``FIX_*``); the
operators themselves are formulated differently from the Spark plans where a
different formulation exists: the report window is a BETWEEN range join (not
the key expansion), the regression is Gram-Schmidt residualisation with window
aggregates (not the unrolled elimination), p-values use closed-form series
terms via lgamma (not the running product).
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# ------------------------------------------------------------------ fixtures

FIX_REPORTS = r"""
report_files AS (
  SELECT 'Z:\reports\' || y::VARCHAR || '_ar_x_y_z_' ||
         (CASE WHEN s_suppkey % 10 = 0 THEN 'OLD' WHEN s_suppkey % 25 = 7 THEN 'ZZZ' ELSE 'SUP' END) ||
         lpad(s_suppkey::VARCHAR, 9, '0') || '_v1.pdf' AS path,
         'src' || (s_suppkey % 20)::VARCHAR || '.' || ((s_suppkey // 20) % (SELECT max(doc_id) // 1000 + 1 FROM documents))::VARCHAR AS doc
  FROM supplier CROSS JOIN (
    SELECT unnest(list_append(range(year(min(l_shipdate)) - 1, year(max(l_shipdate)) + 1), year(max(l_shipdate)) + 5)) AS y
    FROM lineitem) yrs
),
rep0 AS (
  SELECT path, doc, string_split(string_split(path, '\')[-1], '_') AS items FROM report_files
),
rep AS (
  SELECT path, doc, TRY_CAST(items[1] AS INTEGER) AS year, items[6] AS isin,
         make_date(TRY_CAST(items[1] AS INTEGER), 6, 1) AS t0,
         make_date(TRY_CAST(items[1] AS INTEGER) + 1, 6, 1) AS t1,
         make_date(TRY_CAST(items[1] AS INTEGER) + 2, 6, 1) AS t2
  FROM rep0
)"""

FIX_ALIASES = r"""
all_isins AS (
  SELECT 'SUP' || lpad(s_suppkey::VARCHAR, 9, '0') AS isin, s_suppkey AS sid, s_name AS name,
         'IC' || s_suppkey::VARCHAR AS intcode FROM supplier
  UNION ALL
  SELECT 'OLD' || lpad(s_suppkey::VARCHAR, 9, '0'), s_suppkey, s_name, 'IC' || s_suppkey::VARCHAR
  FROM supplier WHERE s_suppkey % 10 = 0
)"""

FIX_EQUITY = r"""
eqx AS (
  SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS date, ln(l_extendedprice) AS lp,
         l_discount, l_tax, l_quantity, p_size
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
),
eqday AS (
  SELECT date, avg(lp) AS ln_delta_mkt, avg(l_tax) / 10 AS bills_ln_rate,
         avg(CASE WHEN p_size <= 25 THEN lp END) - avg(CASE WHEN p_size > 25 THEN lp END) AS smb,
         avg(CASE WHEN l_discount > 0.05 THEN lp END) - avg(CASE WHEN l_discount <= 0.05 THEN lp END) AS hml,
         avg(l_tax) AS liq, avg(l_quantity) AS mom
  FROM eqx GROUP BY date
),
eqsec AS (SELECT sid, date, sum(lp) AS ln_delta_p FROM eqx GROUP BY sid, date),
eq0 AS (
  SELECT 'SUP' || lpad(e.sid::VARCHAR, 9, '0') AS isin, s.s_name AS name, 'IC' || e.sid::VARCHAR AS intcode,
         e.sid, e.date,
         CASE WHEN dayofyear(e.date) % 17 = 0 THEN NULL ELSE d.smb END AS smb,
         CASE WHEN e.sid % 50 = 9 THEN 0.0::DOUBLE ELSE d.hml END AS hml,
         CASE WHEN e.sid % 10 = 3 AND dayofyear(e.date) % 3 <> 0 THEN NULL ELSE d.liq END AS liq,
         d.mom, e.ln_delta_p, d.ln_delta_mkt, d.bills_ln_rate
  FROM eqsec e JOIN eqday d ON e.date = d.date LEFT JOIN supplier s ON s.s_suppkey = e.sid
),
equity AS (SELECT * FROM eq0 UNION ALL SELECT * FROM eq0 WHERE sid % 20 = 1)"""

# Resolution: first row of each DISTINCT lookup in (name, intcode, sid, isin) order.
FIX_RESOLVED = r"""
prim AS (
  SELECT isin AS key, name, intcode, sid, isin AS isin_db,
         row_number() OVER (PARTITION BY isin ORDER BY name NULLS FIRST, intcode NULLS FIRST, sid NULLS FIRST) AS rn
  FROM (SELECT DISTINCT name, intcode, sid, isin FROM equity)
),
fb AS (
  SELECT t1.isin AS key, t1.name, t1.intcode, t2.sid, t2.isin AS isin_db,
         row_number() OVER (PARTITION BY t1.isin ORDER BY t1.name NULLS FIRST, t1.intcode NULLS FIRST,
                            t2.sid NULLS FIRST, t2.isin NULLS FIRST) AS rn
  FROM all_isins t1 LEFT JOIN (SELECT DISTINCT sid, isin FROM equity) t2 ON t1.sid = t2.sid
),
res AS (
  SELECT r.*,
         CASE WHEN p.key IS NOT NULL THEN p.name ELSE f.name END AS name,
         CASE WHEN p.key IS NOT NULL THEN p.intcode ELSE f.intcode END AS intcode,
         CASE WHEN p.key IS NOT NULL THEN p.sid ELSE f.sid END AS sid,
         CASE WHEN p.key IS NOT NULL THEN p.isin_db ELSE f.isin_db END AS isin_db
  FROM rep r
  LEFT JOIN prim p ON p.key = r.isin AND p.rn = 1
  LEFT JOIN fb f ON f.key = r.isin AND f.rn = 1
)"""

FIX_WINDOWS = r"""
win AS (
  SELECT path, isin_db, t0, CASE WHEN h = 1 THEN t1 ELSE t2 END AS tend, h AS horizon
  FROM res CROSS JOIN (VALUES (1), (2)) hs(h)
  WHERE isin_db IS NOT NULL AND year IS NOT NULL
),
ex AS (
  SELECT DISTINCT isin, name, date, smb, hml, liq, mom,
         ln_delta_p - bills_ln_rate AS rx, ln_delta_mkt - bills_ln_rate AS rm
  FROM equity
),
wr AS (
  SELECT w.path, w.horizon, ex.*
  FROM win w JOIN ex ON ex.isin = w.isin_db AND ex.date BETWEEN w.t0 AND w.tend
),
prof AS (
  SELECT path, horizon, count(*) AS n_rows, min(name) AS name,
         count_if(rx IS NULL) AS null_rx, count_if(smb IS NULL) AS null_smb, count_if(hml IS NULL) AS null_hml,
         count_if(liq IS NULL) AS null_liq, count_if(mom IS NULL) AS null_mom, count_if(rm IS NULL) AS null_rm
  FROM wr GROUP BY path, horizon
),
prof2 AS (
  SELECT *, null_smb > n_rows * 0.5 AS drop_smb, null_hml > n_rows * 0.5 AS drop_hml,
         null_liq > n_rows * 0.5 AS drop_liq, null_mom > n_rows * 0.5 AS drop_mom, null_rm > n_rows * 0.5 AS drop_rm
  FROM prof
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


REPORT_CTES = (FIX_REPORTS, FIX_ALIASES, FIX_EQUITY, FIX_RESOLVED, FIX_WINDOWS)

# ------------------------------------------------------------ step 1 / 2

ORACLES["reports_scan"] = with_(FIX_REPORTS) + r"""
SELECT string_split(path, '\')[-1] AS name, strlen(path)::BIGINT AS n_bytes, year, isin,
       strftime(t0, '%Y-%m-%d') AS t0, strftime(t1, '%Y-%m-%d') AS t1, strftime(t2, '%Y-%m-%d') AS t2
FROM rep
UNION ALL SELECT 'readme.txt', 12, NULL, NULL, NULL, NULL, NULL"""

ORACLES["equity_excess"] = with_(FIX_EQUITY) + """
SELECT isin, name, strftime(date, '%Y-%m-%d') AS date, round(smb, 6) AS smb, round(hml, 6) AS hml,
       round(liq, 10) AS liq, round(mom, 8) AS mom, round(rx, 6) AS rx, round(rm, 6) AS rm
FROM (SELECT DISTINCT isin, name, date, smb, hml, liq, mom,
             ln_delta_p - bills_ln_rate AS rx, ln_delta_mkt - bills_ln_rate AS rm FROM equity)"""

ORACLES["equity_window_join"] = with_(*REPORT_CTES) + """
SELECT path, horizon, count(*) AS n_rows, strftime(min(date), '%Y-%m-%d') AS first_date,
       strftime(max(date), '%Y-%m-%d') AS last_date, round(sum(rx), 6) AS sum_rx
FROM wr GROUP BY path, horizon"""

ORACLES["numeric_coerce"] = with_(FIX_EQUITY) + """
SELECT isin, count(*) AS n_rows, 0::BIGINT AS n_isin, 0::BIGINT AS n_name, 0::BIGINT AS n_date,
       count(smb) AS n_smb, count(hml) AS n_hml, count(liq) AS n_liq, count(mom) AS n_mom,
       count(rx) AS n_rx, count(rm) AS n_rm,
       round(sum(smb), 6) AS sum_smb, round(sum(hml), 6) AS sum_hml, round(sum(rx), 6) AS sum_rx,
       round(sum(rm), 6) AS sum_rm
FROM (SELECT DISTINCT isin, name, date, smb, hml, liq, mom,
             ln_delta_p - bills_ln_rate AS rx, ln_delta_mkt - bills_ln_rate AS rm FROM equity)
GROUP BY isin"""

ORACLES["isin_resolve"] = with_(FIX_REPORTS, FIX_ALIASES, FIX_EQUITY, FIX_RESOLVED) + """
SELECT path, isin, name, intcode, sid, isin_db, coalesce(sid::VARCHAR, intcode) AS sid_or_code FROM res"""

ORACLES["missing_profile"] = with_(*REPORT_CTES) + """
SELECT path, horizon, n_rows, name, null_rx, null_smb, null_hml, null_liq, null_mom, null_rm,
       drop_smb, drop_hml, drop_liq, drop_mom, drop_rm
FROM prof2"""

# ----------------------------------------------------- regression (Gram-Schmidt)

_X = ["smb", "hml", "liq", "mom", "rm"]
_G = "OVER (PARTITION BY path, horizon)"


def _gs_ctes(sparse: bool) -> list[str]:
    """Residualise each regressor on the previous ones (classical Gram-Schmidt
    with group window aggregates), then the response; z_j(0) tracks the value
    of each basis vector at the origin for the intercept."""
    drops = {x: (f"p.drop_{x}" if sparse else "FALSE") for x in _X}
    sel = ", ".join(f"CASE WHEN {drops[x]} THEN 0.0 ELSE w.{x} END AS x{j}" for j, x in enumerate(_X, 1))
    cond = " AND ".join(f"({drops[x]} OR w.{x} IS NOT NULL)" for x in _X)
    flags = ", ".join(f"{drops[x]} AS d{j}" for j, x in enumerate(_X, 1))
    ctes = [
        f"""g0 AS (
  SELECT w.path, w.horizon, w.rx AS y, {sel}, {flags}
  FROM wr w JOIN prof2 p ON p.path = w.path AND p.horizon = w.horizon
  WHERE w.rx IS NOT NULL AND {cond}
)"""
    ]
    prev = "g0"
    for j in range(1, 6):
        # a: projection coefficients on earlier basis vectors and the mean
        coefs = [f"avg(x{j}) {_G} AS m{j}", f"var_pop(x{j}) {_G} * count(*) {_G} AS ss{j}"]
        for i in range(1, j):
            coefs.append(f"CASE WHEN ok{i} THEN sum(x{j} * z{i}) {_G} / nz{i} ELSE 0.0 END AS c{j}_{i}")
        ctes.append(f"a{j} AS (SELECT *, {', '.join(coefs)} FROM {prev})")
        z = f"(x{j} - m{j})" + "".join(f" - c{j}_{i} * z{i}" for i in range(1, j))
        zo = f"(-m{j})" + "".join(f" - c{j}_{i} * zo{i}" for i in range(1, j))
        ctes.append(f"b{j} AS (SELECT *, {z} AS z{j}, {zo} AS zo{j} FROM a{j})")
        ctes.append(
            f"c{j} AS (SELECT *, sum(z{j} * z{j}) {_G} AS nz{j}, "
            f"(ss{j} > 0 AND sum(z{j} * z{j}) {_G} > 1e-12 * ss{j}) AS ok{j} FROM b{j})"
        )
        prev = f"c{j}"
    ycoef = ", ".join(f"CASE WHEN ok{i} THEN sum(y * z{i}) {_G} / nz{i} ELSE 0.0 END AS cy_{i}" for i in range(1, 6))
    ctes.append(f"ay AS (SELECT *, avg(y) {_G} AS my, {ycoef} FROM {prev})")
    e = "(y - my)" + "".join(f" - cy_{i} * z{i}" for i in range(1, 6))
    ctes.append(f"ey AS (SELECT *, {e} AS e FROM ay)")
    skip = " + ".join(f"(CASE WHEN NOT d{j} AND NOT ok{j} THEN 1 ELSE 0 END)" for j in range(1, 6))
    kexpr = "1 + " + " + ".join(f"(CASE WHEN d{j} THEN 0 ELSE 1 END)" for j in range(1, 6))
    alpha = "any_value(my)" + "".join(f" + any_value(cy_{i} * zo{i})" for i in range(1, 6))
    qa = " + ".join(f"any_value(CASE WHEN ok{i} THEN zo{i} * zo{i} / nz{i} ELSE 0.0 END)" for i in range(1, 6))
    ctes.append(
        f"""fin AS (
  SELECT path, horizon, count(*) AS n_obs, any_value({kexpr}) AS k,
         any_value({skip}) AS skipped, sum(e * e) AS rss, {alpha} AS alpha0,
         any_value(CASE WHEN ok5 THEN cy_5 END) AS beta0, any_value(nz5) AS nz5, {qa} AS qa,
         any_value(d5) AS drop_rm
  FROM ey GROUP BY path, horizon
)"""
    )
    return ctes


def _ols_select(sparse: bool, with_p: bool = False) -> str:
    src = "prof2 p LEFT JOIN fin f ON f.path = p.path AND f.horizon = p.horizon" if sparse else "fin f"
    keys = "p.path, p.horizon" if sparse else "f.path, f.horizon"
    kk = ("1 + " + " + ".join(f"(CASE WHEN p.drop_{x} THEN 0 ELSE 1 END)" for x in _X)) if sparse else "6"
    return f"""
, st AS (
  SELECT {keys}, coalesce(f.n_obs, 0)::BIGINT AS n_obs, ({kk} - coalesce(f.skipped, 0))::INTEGER AS k, f.skipped, f.rss, f.alpha0, f.beta0,
         f.nz5, f.qa, coalesce(f.drop_rm, FALSE) AS drop_rm
  FROM {src}
),
st2 AS (
  SELECT *, (skipped IS NOT NULL AND n_obs > k) AS ok,
         rss / (n_obs - k) AS sigma2
  FROM st
),
st3 AS (
  SELECT path, horizon, n_obs, k,
         CASE WHEN ok THEN (n_obs - k)::BIGINT END AS df,
         CASE WHEN ok THEN alpha0 END AS alpha,
         CASE WHEN ok AND NOT drop_rm THEN beta0 END AS beta,
         CASE WHEN ok AND sigma2 * (1.0 / n_obs + qa) > 0 THEN alpha0 / sqrt(sigma2 * (1.0 / n_obs + qa)) END AS t_alpha,
         CASE WHEN ok AND NOT drop_rm AND sigma2 / nz5 > 0 THEN beta0 / sqrt(sigma2 / nz5) END AS t_beta,
         NOT ok OR skipped > 0 AS singular
  FROM st2
)"""


def _tp(t: str, v: str) -> str:
    """Two-sided t p-value from closed-form series terms (lgamma)."""
    th = f"atan(abs({t}) / sqrt({v}))"
    c2 = f"(cos({th}) * cos({th}))"
    odd = (
        f"(2.0 / pi()) * ({th} + sin({th}) * cos({th}) * coalesce(list_sum(list_transform(range(1, ({v} - 1) // 2 + 1), "
        f"lambda j: power({c2}, j - 1) * exp((j - 1) * ln(4.0) + 2 * lgamma(j) - lgamma(2 * j)))), 0.0))"
    )
    even = (
        f"sin({th}) * coalesce(list_sum(list_transform(range(1, {v} // 2 + 1), "
        f"lambda j: power({c2}, j - 1) * exp(lgamma(2 * j - 1) - (j - 1) * ln(4.0) - 2 * lgamma(j)))), 0.0)"
    )
    # from |t| = 4 on, the tail itself: the incomplete beta function's power series, all terms positive
    x = f"({v} / ({v} + {t} * {t}))"
    tail = (
        f"exp({v} / 2.0 * ln({x}) + 0.5 * ln(1 - {x})) * list_sum(list_transform(range(0, 4000), "
        f"lambda j: exp(lgamma({v} / 2.0 + 0.5 + j) - lgamma(0.5) - lgamma({v} / 2.0 + 1 + j) + j * ln({x}))))"
    )
    return (f"CASE WHEN {t} IS NOT NULL AND {v} >= 1 THEN CASE WHEN abs({t}) >= 4 THEN {tail} "
            f"ELSE greatest(0.0, 1.0 - CASE WHEN {v} % 2 = 1 THEN {odd} ELSE {even} END) END END")


def _ols_sql(sparse: bool) -> str:
    return with_(*REPORT_CTES, *_gs_ctes(sparse)).rstrip("\n") + _ols_select(sparse)


for _key, _sparse in (("factor_ols", False), ("factor_ols_sparse", True)):
    ORACLES[_key] = _ols_sql(_sparse) + """
SELECT path, horizon, n_obs, k, df, round(alpha, 6) AS alpha, round(beta, 6) AS beta,
       round(t_alpha, 6) AS t_alpha, round(t_beta, 6) AS t_beta, singular
FROM st3"""

ORACLES["factor_pvalues"] = _ols_sql(True) + f"""
, pv AS (SELECT path, horizon, df, {_tp('t_alpha', 'df')} AS pa, {_tp('t_beta', 'df')} AS pb FROM st3)
SELECT path, horizon, df, round(pa, 8) AS pval_alpha, round(pb, 8) AS pval_beta,
       round(CASE WHEN pa > 0 THEN log10(pa) END, 6) AS log_pval_alpha, round(CASE WHEN pb > 0 THEN log10(pb) END, 6) AS log_pval_beta
FROM pv"""

# ------------------------------------------------------------ step 4: text

_NUM = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)\s*$"
_SPLIT = r"[ \t\n\r\f\x0B]+"

ORACLES["is_number"] = f"""
WITH tok AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '{_SPLIT}'), lambda t: t <> '') AS ts FROM documents
)
SELECT doc_id, len(ts)::BIGINT AS n_tokens,
       len(list_filter(ts, lambda t: regexp_matches(regexp_replace(t, '[, $()%]', '', 'g'), '{_NUM}')))::BIGINT AS n_number_table,
       len(list_filter(ts, lambda t: regexp_matches(regexp_replace(t, '[, ]', '', 'g'), '{_NUM}')))::BIGINT AS n_number_row,
       len(list_filter(ts, lambda t: regexp_matches(t, '^\\s*[+-]?\\d+\\s*$')))::BIGINT AS n_integer
FROM tok"""

ORACLES["clean_text"] = r"""
WITH both_ AS (
  SELECT doc_id AS id, 'doc' AS kind, text FROM documents
  UNION ALL SELECT page_id, 'page', html FROM pages
), c AS (
  SELECT id, kind, text, regexp_replace(regexp_replace(text, '\r+\n', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g') AS out
  FROM both_
)
SELECT id, kind, length(text)::BIGINT AS n_in, length(out)::BIGINT AS n_out, md5(out) AS md5_out FROM c"""

FIX_RESPONSES = r"""
resp0 AS (
  SELECT d.doc_id, (d.doc_id % 11)::VARCHAR AS g, d.text AS t, d.doc_id % 8 AS kind
  FROM documents d
),
responses AS (
  SELECT doc_id AS report,
         CASE kind WHEN 0 THEN g || '; ' || t WHEN 1 THEN 'None; ' || t
                   WHEN 2 THEN 'The grade is ' || g || ' because ' || t WHEN 3 THEN 'None of the data ' || t
                   WHEN 4 THEN g || '; a; b' WHEN 5 THEN 'no grade' WHEN 6 THEN '12; out of range'
                   ELSE g || '.5; ' || t END AS resp
  FROM resp0
)"""

# Grade parse written as a per-case table of the reference's branches.
ORACLES["grade_parse"] = with_(FIX_RESPONSES) + r"""
, p AS (
  SELECT report, resp, strpos(resp, ';') AS spos, split_part(resp, ';', 1) AS head,
         regexp_extract(substring(resp, 1, 40), '\b(\d{1,2})\b', 1) AS m
  FROM responses
), p2 AS (
  SELECT *, regexp_matches(head, '^\s*[+-]?\d+\s*$') AS int_head, TRY_CAST(m AS INTEGER) AS g2 FROM p
)
SELECT report, resp,
       CASE WHEN spos > 0 THEN (CASE WHEN int_head THEN TRY_CAST(trim(head) AS INTEGER) END)
            WHEN m <> '' THEN g2 END AS grade,
       CASE WHEN spos > 0 THEN (CASE WHEN head = 'None' OR int_head THEN substring(resp, spos + 1) ELSE resp END)
            WHEN m <> '' THEN substring(resp, strpos(resp, g2::VARCHAR) + 2)
            WHEN contains(substring(resp, 1, 10), 'None') THEN substring(resp, 6)
            ELSE resp END AS answer
FROM p2"""

# English letter frequencies, as in operators.letters.
_FREQ = {
    "A": 0.082, "B": 0.015, "C": 0.028, "D": 0.043, "E": 0.127, "F": 0.022, "G": 0.02, "H": 0.061,
    "I": 0.07, "J": 0.0015, "K": 0.0077, "L": 0.04, "M": 0.024, "N": 0.067, "O": 0.075, "P": 0.019,
    "Q": 0.00095, "R": 0.06, "S": 0.063, "T": 0.091, "U": 0.028, "V": 0.0098, "W": 0.024, "X": 0.0015,
    "Y": 0.02, "Z": 0.00074,
}
# Oracle formulation: explode characters and join the frequency table; the
# zero-count letters enter through sum(n*f) - 2*sum(obs) + sum(obs^2/(n*f)).
ORACLES["letter_profile"] = (
    "WITH freq(letter, f) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _FREQ.items()) + r"""),
ch AS (
  SELECT doc_id, upper(c) AS letter FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), '')) AS c FROM documents)
  WHERE regexp_matches(c, '^[A-Za-z]$')
),
cnt AS (SELECT doc_id, letter, count(*)::DOUBLE AS obs FROM ch GROUP BY doc_id, letter),
tot AS (SELECT doc_id, sum(obs) AS n FROM cnt GROUP BY doc_id),
agg AS (
  SELECT c.doc_id, t.n, sum(c.obs * c.obs / (t.n * f.f)) AS s2
  FROM cnt c JOIN tot t USING (doc_id) JOIN freq f USING (letter) GROUP BY c.doc_id, t.n
)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_letters,
       round(a.s2 - 2 * a.n + a.n * (SELECT sum(f) FROM freq), 6) AS chi2
FROM documents d LEFT JOIN agg a USING (doc_id)"""
)

# ------------------------------------------------------------ step 5/6: documents

# Fixed values, written down here again so that an error in the engine's shows:
# white space as Python strips it, the page's style and end, ASCII letters and
# the private-use letters that stand for them.
_PYS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
        r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
_CSS = ".markdown-table { white-space: pre; font-family: monospace; }"
_TAIL = "</body>\n</html>\n"
_LET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PUA = "".join(map(chr, range(0xE000, 0xE034)))

_STRIP = f"'^{_PYS}+|{_PYS}+$'"


def _pystrip(x: str) -> str:
    return f"regexp_replace({x}, {_STRIP}, '', 'g')"


def _fk(font: str, size: str, color: str) -> str:
    return (f"{font} || ':' || (CASE WHEN {size} = floor({size}) THEN CAST(CAST(floor({size}) AS BIGINT) AS VARCHAR) || '.0' "
            f"ELSE CAST({size} AS VARCHAR) END) || ':' || CAST({color} AS VARCHAR)")


def _styled(t: str, f: str) -> str:
    b = f"(CASE WHEN contains({f}, 'Bold') THEN '<b>' || {t} || '</b>' ELSE {t} END)"
    return f"(CASE WHEN contains({f}, 'Italic') THEN '<i>' || {b} || '</i>' ELSE {b} END)"


FIX_DOCS = f"""
dd AS (
  SELECT doc_id, source || '.' || (doc_id // 1000)::VARCHAR AS source, text FROM documents
  UNION ALL
  SELECT doc_id, source || '.' || (doc_id // 1000)::VARCHAR || '-pua', translate(regexp_replace(text, '[^A-Za-z\\n]', '', 'g'), '{_LET}', '{_PUA}')
  FROM documents WHERE source = 'src5'
),
dl AS (
  SELECT source, doc_id, unnest(range(len(parts))) AS li, unnest(parts) AS line, len(parts) AS n
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM dd)
),
dn AS (SELECT DISTINCT source, doc_id, n FROM dl),
dgeo AS (
  SELECT source, doc_id, n, doc_id % 3 = 0 AS wide,
         CASE WHEN doc_id % 3 = 0 THEN 1000.0 WHEN doc_id % 3 = 1 THEN 700.0 ELSE 500.0 END AS page_w,
         CASE WHEN doc_id % 3 = 1 THEN 300.0 ELSE 450.0 END AS l1
  FROM dn
),
dsp0 AS (
  SELECT source AS report, doc_id AS page_no, 0 AS block_no, 0 AS span_no, 'Annual report ' || source AS text,
         'Hd-Italic' AS font, 8.0 AS size, 50.0 AS x0, l1 AS x1 FROM dgeo
  UNION ALL
  SELECT g.source, g.doc_id, 1, 0, substring(l.line, 1, 40), 'Title-Bold', 14.0,
         CASE WHEN g.doc_id % 6 = 0 THEN 300.0 ELSE 50.0 END, CASE WHEN g.doc_id % 6 = 0 THEN 700.0 ELSE g.l1 END
  FROM dgeo g JOIN dl l ON l.doc_id = g.doc_id AND l.source = g.source AND l.li = 0
  UNION ALL
  SELECT g.source, g.doc_id, l.li + 2, 0, l.line, 'Body', 10.0,
         CASE WHEN g.wide AND l.li % 2 = 1 THEN 550.0 ELSE 50.0 END, CASE WHEN g.wide AND l.li % 2 = 1 THEN 950.0 ELSE g.l1 END
  FROM dgeo g JOIN dl l ON l.doc_id = g.doc_id AND l.source = g.source
  WHERE NOT ((l.li + 1) % 7 = 0 AND length(l.line) > 10)
  UNION ALL
  SELECT g.source, g.doc_id, l.li + 2, 0, substring(l.line, 1, 10), 'Body-Bold', 10.0,
         CASE WHEN g.wide AND l.li % 2 = 1 THEN 550.0 ELSE 50.0 END,
         CASE WHEN g.wide AND l.li % 2 = 1 THEN 750.0 ELSE (50.0 + g.l1) / 2 END
  FROM dgeo g JOIN dl l ON l.doc_id = g.doc_id AND l.source = g.source
  WHERE (l.li + 1) % 7 = 0 AND length(l.line) > 10
  UNION ALL
  SELECT g.source, g.doc_id, l.li + 2, 1, substring(l.line, 11), 'Body', 10.0,
         CASE WHEN g.wide AND l.li % 2 = 1 THEN 750.0 ELSE (50.0 + g.l1) / 2 END,
         CASE WHEN g.wide AND l.li % 2 = 1 THEN 950.0 ELSE g.l1 END
  FROM dgeo g JOIN dl l ON l.doc_id = g.doc_id AND l.source = g.source
  WHERE (l.li + 1) % 7 = 0 AND length(l.line) > 10
  UNION ALL
  SELECT source, doc_id, n + 2, 0, CAST(doc_id AS VARCHAR), 'Body', 8.0,
         CASE WHEN wide THEN 550.0 ELSE 50.0 END, CASE WHEN wide THEN 600.0 ELSE 100.0 END FROM dgeo
),
cust AS (
  SELECT o_custkey AS k, 'src' || (o_custkey % 20)::VARCHAR || '.' || (o_custkey // 1500)::VARCHAR AS report,
         o_custkey + 10000000000 AS page_no, o_orderkey, o_totalprice, o_orderdate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS rw
  FROM orders
),
custc AS (
  SELECT DISTINCT k, report, page_no, 0 AS rw, 0 AS col, 'Orders of customer ' || k::VARCHAR AS text FROM cust
  UNION ALL SELECT DISTINCT k, report, page_no, 1, 0, 'Account ' || k::VARCHAR FROM cust
  UNION ALL SELECT DISTINCT k, report, page_no, 1, 1, 'Total' FROM cust
  UNION ALL SELECT DISTINCT k, report, page_no, 1, 2, 'Year' FROM cust
  UNION ALL SELECT k, report, page_no, rw, 0, 'Order ' || o_orderkey::VARCHAR FROM cust
  UNION ALL SELECT k, report, page_no, rw, 1, format('{{:,.2f}}', o_totalprice) FROM cust
  UNION ALL SELECT k, report, page_no, rw, 2, year(o_orderdate)::VARCHAR FROM cust
),
dsp AS (
  SELECT report, page_no, CASE WHEN page_no % 3 = 0 THEN 1000.0 WHEN page_no % 3 = 1 THEN 700.0 ELSE 500.0 END AS page_w,
         700.0 AS page_h, block_no, 0 AS line_no, span_no, text, font, size, 0 AS color, x0, x1,
         40.0 + 12.0 * block_no AS y0, 40.0 + 12.0 * block_no + size AS y1
  FROM dsp0
  UNION ALL
  SELECT report, page_no, CASE WHEN k % 7 = 0 THEN 1000.0 ELSE 600.0 END, CASE WHEN k % 7 = 0 THEN 700.0 ELSE 800.0 END,
         rw, col, 0, text, 'Body', 10.0, 0,
         CASE WHEN col = 0 THEN 20.0 ELSE 150.0 + 100.0 * col - 5.0 * length(text) END,
         CASE WHEN col = 0 THEN 20.0 + 5.0 * length(text) ELSE 150.0 + 100.0 * col END,
         40.0 + 20.0 * rw, 50.0 + 20.0 * rw
  FROM custc
),
dpages AS (
  SELECT source || '.' || (doc_id // 1000)::VARCHAR AS report, doc_id AS page_no FROM documents
  UNION ALL SELECT source || '.' || (doc_id // 1000)::VARCHAR || '-pua', doc_id FROM documents WHERE source = 'src5'
  UNION ALL SELECT 'empty', min(doc_id) FROM documents
  UNION ALL SELECT DISTINCT report, page_no FROM cust
)"""

FIX_DOCFLOW = f"""
bx AS (
  SELECT *, min(x0) OVER (PARTITION BY report, page_no, block_no, line_no) AS lx0,
         max(x1) OVER (PARTITION BY report, page_no, block_no, line_no) AS lx1,
         min(x0) OVER (PARTITION BY report, page_no, block_no) AS bx0,
         max(x1) OVER (PARTITION BY report, page_no, block_no) AS bx1
  FROM dsp
),
pg AS (
  SELECT report, page_no,
         bool_or(bx0 < page_w / 2 AND page_w / 2 < bx1 AND lx0 < page_w / 2 AND page_w / 2 < lx1
                 AND x0 < page_w / 2 AND page_w / 2 < x1) AS blocked
  FROM bx GROUP BY report, page_no
),
sp AS (
  SELECT b.*, CASE WHEN b.page_w >= b.page_h AND NOT p.blocked AND b.bx0 >= b.page_w / 2 THEN 1 ELSE 0 END AS half,
         b.page_w >= b.page_h AND NOT p.blocked AS split
  FROM bx b JOIN pg p USING (report, page_no)
),
sp2 AS (
  SELECT report, page_no * 2 + half AS page_key, block_no, line_no, span_no, text, font, size, color,
         CASE WHEN split THEN page_w / 2 ELSE page_w END AS page_w,
         x0 - half * page_w / 2 AS x0, x1 - half * page_w / 2 AS x1, y0, y1
  FROM sp
),
blk AS (
  SELECT report, page_key, block_no,
         coalesce(string_agg(CASE WHEN length({_pystrip('text')}) > 0
                                   AND NOT regexp_matches({_pystrip('text')}, '^\\s*[+-]?\\d+\\s*$')
                              THEN font || (CASE WHEN size = floor(size) THEN CAST(CAST(floor(size) AS BIGINT) AS VARCHAR) || '.0'
                                            ELSE CAST(size AS VARCHAR) END) || ':' || text END, ';'
                              ORDER BY line_no, span_no), '') AS block_key,
         count(DISTINCT line_no) AS n_lines,
         sum(length(text)) + count(DISTINCT line_no) AS text_len,
         sum(length(regexp_replace(text, '[^\\x{{E000}}-\\x{{F8FF}}\\x{{F0000}}-\\x{{FFFFD}}\\x{{100000}}-\\x{{10FFFD}}]', '', 'g'))) AS n_private
  FROM sp2 GROUP BY report, page_key, block_no
),
rep_keys AS (
  SELECT report, block_key, count(*) AS n FROM blk WHERE n_lines BETWEEN 1 AND 5
  GROUP BY report, block_key HAVING count(*) > 10
),
kb AS (SELECT * FROM blk b WHERE NOT EXISTS (SELECT 1 FROM rep_keys r WHERE r.report = b.report AND r.block_key = b.block_key)),
dstat AS (
  SELECT p.report, coalesce(k.n_blocks, 0) AS n_blocks, coalesce(k.n_chars, 0) AS n_chars,
         coalesce(k.n_private, 0) AS n_private,
         CASE WHEN coalesce(k.n_chars, 0) > 0 THEN k.n_private / k.n_chars END AS private_share
  FROM (SELECT DISTINCT report FROM dpages) p
  LEFT JOIN (SELECT report, count(*) AS n_blocks, sum(text_len) AS n_chars, sum(n_private) AS n_private FROM kb GROUP BY report) k
  USING (report)
),
dstat2 AS (
  SELECT *, CASE WHEN n_chars = 0 THEN 'no content' WHEN private_share > 0.9 THEN 'unreadable' ELSE 'ok' END AS status FROM dstat
),
kbo AS (SELECT kb.* FROM kb JOIN dstat2 s USING (report) WHERE s.status = 'ok'),
ks AS (
  SELECT s.*, {_fk('s.font', 's.size', 's.color')} AS font_key
  FROM sp2 s JOIN kbo k USING (report, page_key, block_no)
),
kbend AS (
  SELECT report, page_key, block_no,
         sum(text_len) OVER (PARTITION BY report ORDER BY page_key, block_no ROWS UNBOUNDED PRECEDING) AS end_off
  FROM kbo
),
lk AS (
  SELECT report, page_key, block_no, line_no, count(DISTINCT font_key) AS nk FROM ks GROUP BY ALL
),
fent AS (
  SELECT s.report, s.font_key, e.end_off + sum(length(s.text)) OVER (PARTITION BY s.report, s.page_key, s.block_no, s.line_no
                                                                      ORDER BY s.span_no ROWS UNBOUNDED PRECEDING) AS pos,
         {_pystrip('s.text')} AS text, s.page_key, s.block_no, s.line_no, s.span_no
  FROM ks s JOIN lk USING (report, page_key, block_no, line_no) JOIN kbend e USING (report, page_key, block_no)
  WHERE lk.nk > 1
  UNION ALL
  SELECT s.report, any_value(s.font_key), any_value(e.end_off),
         {_pystrip("string_agg(s.text, '' ORDER BY s.span_no)")}, s.page_key, s.block_no, s.line_no, min(s.span_no)
  FROM ks s JOIN lk USING (report, page_key, block_no, line_no) JOIN kbend e USING (report, page_key, block_no)
  WHERE lk.nk = 1
  GROUP BY s.report, s.page_key, s.block_no, s.line_no
),
fst0 AS (
  SELECT report, font_key, count(*) AS n_entries, sum(length(text)) AS text_len, count(DISTINCT text) AS n_distinct,
         avg(length(text)) AS mean_len, min(pos) AS first_pos, max(pos) AS last_pos,
         min((page_key, block_no, line_no, span_no)) AS first_ord
  FROM fent GROUP BY report, font_key
),
fst AS (
  SELECT *, text_len / sum(text_len) OVER (PARTITION BY report) AS share,
         first_pos / sum(text_len) OVER (PARTITION BY report) AS start_,
         last_pos / sum(text_len) OVER (PARTITION BY report) AS end_
  FROM fst0
),
bodyf AS (
  SELECT report, font_key AS body_font FROM (
    SELECT report, font_key, row_number() OVER (PARTITION BY report ORDER BY n_entries DESC, first_ord) AS rn FROM fst)
  WHERE rn = 1
),
hc AS (
  SELECT *, end_ - start_ AS ext FROM fst
  WHERE share < 0.05 AND n_distinct > 4 AND mean_len > 10 AND mean_len < 500
),
hlev AS (
  SELECT report, max(CASE WHEN ext > 0.8 THEN 0.8 WHEN ext > 0.6 THEN 0.6 WHEN ext > 0.4 THEN 0.4 WHEN ext > 0.2 THEN 0.2 END) AS lv
  FROM hc GROUP BY report
),
headf AS (
  SELECT r.report, coalesce(h.font_key, '') AS heading_font
  FROM (SELECT DISTINCT report FROM fst) r
  LEFT JOIN (
    SELECT report, font_key FROM (
      SELECT hc.report, hc.font_key,
             row_number() OVER (PARTITION BY hc.report ORDER BY n_distinct, n_entries DESC, first_ord) AS rn
      FROM hc JOIN hlev USING (report) WHERE hc.ext > hlev.lv)
    WHERE rn = 1
  ) h USING (report)
),
kplain AS (
  SELECT report, page_key, block_no,
         coalesce(sum(1 + sum(length(text) + 2)) OVER (PARTITION BY report ORDER BY page_key, block_no
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS plain_before
  FROM ks GROUP BY report, page_key, block_no
),
hcand AS (
  SELECT s.report, s.page_key, s.block_no, s.line_no, s.span_no, p.plain_before,
         replace(replace(replace(replace({_pystrip('lower(' + _styled('s.text', 's.font') + ')')},
                 ' cont', ''), ' continued', ''), ' forts.', ''), ' fortsettelse', '') AS head_key,
         row_number() OVER (PARTITION BY s.report ORDER BY s.page_key, s.block_no, s.line_no, s.span_no) AS rn
  FROM ks s JOIN headf h ON h.report = s.report AND s.font_key = h.heading_font
  JOIN kplain p ON p.report = s.report AND p.page_key = s.page_key AND p.block_no = s.block_no
),
hrec AS (
  SELECT report, rn, plain_before AS last, [head_key] AS used, TRUE AS accepted FROM hcand WHERE rn = 1
  UNION ALL
  SELECT c.report, c.rn,
         CASE WHEN c.plain_before - r.last < 1000 OR list_contains(r.used, c.head_key) THEN r.last ELSE c.plain_before END,
         CASE WHEN c.plain_before - r.last < 1000 OR list_contains(r.used, c.head_key) THEN r.used
              ELSE list_append(r.used, c.head_key) END,
         NOT (c.plain_before - r.last < 1000 OR list_contains(r.used, c.head_key))
  FROM hrec r JOIN hcand c ON c.report = r.report AND c.rn = r.rn + 1
),
hacc AS (SELECT c.*, r.accepted FROM hcand c JOIN hrec r USING (report, rn)),
bpieces AS (
  SELECT s.report, s.page_key, s.block_no, s.line_no, s.span_no,
         CASE WHEN coalesce(a.accepted, FALSE) THEN '<h1>' || {_styled('s.text', 's.font')} || '</h1>' || chr(10)
              WHEN s.span_no < max(CASE WHEN a.accepted THEN s.span_no END) OVER (PARTITION BY s.report, s.page_key, s.block_no, s.line_no)
                THEN NULL
              ELSE ' ' || {_styled('s.text', 's.font')} || ' ' END AS p
  FROM ks s LEFT JOIN hacc a USING (report, page_key, block_no, line_no, span_no)
),
bhtml0 AS (
  SELECT report, page_key, block_no, chr(10) || '<p>' || coalesce(string_agg(p, '' ORDER BY line_no, span_no), '') AS h
  FROM bpieces GROUP BY report, page_key, block_no
),
bhtml AS (SELECT report, page_key, block_no, CASE WHEN contains(h, '</p>') THEN h ELSE h || '</p>' END AS html FROM bhtml0)"""

# From positioned spans (tsp) to the markdown of each numeric table.
TABLE_FLOW = f"""
tx AS (
  SELECT *, row_number() OVER (PARTITION BY report, page_no ORDER BY block_no, line_no, span_no) - 1 AS idx,
         regexp_matches(regexp_replace(text, '[, $()%]', '', 'g'), '{_NUM}') AS isnum
  FROM tsp
),
tb AS (
  SELECT report, page_no, count(*) AS n, min(CASE WHEN isnum THEN idx END) AS f, max(CASE WHEN isnum THEN idx END) AS l
  FROM tx GROUP BY report, page_no
),
tex AS (
  SELECT tx.* FROM tx JOIN tb USING (report, page_no)
  WHERE f IS NOT NULL AND f <= l - 2 AND idx >= greatest(1, f - 6) AND idx < least(l + 5, n)
),
tax AS (
  SELECT report, page_no, idx, 'x' AS axis, x0 AS a, x1 AS b FROM tex
  UNION ALL SELECT report, page_no, idx, 'y', y0, y1 FROM tex
),
taxp AS (SELECT *, row_number() OVER (PARTITION BY report, page_no, axis ORDER BY a, idx) - 1 AS pos FROM tax),
tcov1 AS (
  SELECT p.report, p.page_no, p.axis, p.idx, p.pos, p.a, count(*) AS c1
  FROM taxp p JOIN taxp q ON q.report = p.report AND q.page_no = p.page_no AND q.axis = p.axis AND q.pos <= p.pos AND q.b >= p.a
  GROUP BY p.report, p.page_no, p.axis, p.idx, p.pos, p.a
),
tcut AS (
  SELECT report, page_no, axis, min(pos) AS cut FROM (
    SELECT *, lag(c1) OVER (PARTITION BY report, page_no, axis ORDER BY pos) AS prev FROM tcov1)
  WHERE pos >= 2 AND c1 < prev GROUP BY report, page_no, axis
),
tcov2 AS (
  SELECT p.report, p.page_no, p.axis, p.pos, p.a, count(*) AS c2
  FROM taxp p LEFT JOIN tcut c ON c.report = p.report AND c.page_no = p.page_no AND c.axis = p.axis
  JOIN taxp q ON q.report = p.report AND q.page_no = p.page_no AND q.axis = p.axis AND q.pos <= p.pos AND q.b >= p.a
       AND (c.cut IS NULL OR p.pos < c.cut OR q.pos >= c.cut)
  GROUP BY p.report, p.page_no, p.axis, p.pos, p.a
),
tnew AS (
  SELECT *, CASE WHEN pos > 0 AND c2 - coalesce(lag(c2) OVER (PARTITION BY report, page_no, axis ORDER BY pos), 0) <= 0
                 THEN 1 ELSE 0 END AS brk
  FROM tcov2
),
tgrp0 AS (SELECT *, sum(brk) OVER (PARTITION BY report, page_no, axis ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM tnew),
tgrp AS (SELECT report, page_no, axis, a AS coord, max(grp) AS grp FROM tgrp0 GROUP BY report, page_no, axis, a),
tcell0 AS (
  SELECT e.report, e.page_no, gy.grp AS gy, gx.grp AS gx,
         arg_max(translate(e.text, chr(9) || chr(10), ''), e.idx) AS raw, arg_max(e.block_no, e.idx) AS block_no
  FROM tex e
  JOIN tgrp gx ON gx.report = e.report AND gx.page_no = e.page_no AND gx.axis = 'x' AND gx.coord = e.x0
  JOIN tgrp gy ON gy.report = e.report AND gy.page_no = e.page_no AND gy.axis = 'y' AND gy.coord = e.y0
  GROUP BY e.report, e.page_no, gy.grp, gx.grp
),
tcell1 AS (SELECT *, CASE WHEN raw IN ('', ' ', '  ') THEN NULL ELSE raw END AS text FROM tcell0),
tcolok AS (SELECT report, page_no, gx FROM tcell1 GROUP BY ALL HAVING count(text) > 0),
trowok AS (SELECT c.report, c.page_no, c.gy FROM tcell1 c JOIN tcolok USING (report, page_no, gx) GROUP BY ALL HAVING count(c.text) > 0),
tcells2 AS (
  SELECT c.report, c.page_no,
         dense_rank() OVER (PARTITION BY c.report, c.page_no ORDER BY c.gy) - 1 AS rw,
         dense_rank() OVER (PARTITION BY c.report, c.page_no ORDER BY c.gx) - 1 AS col, c.text, c.block_no
  FROM tcell1 c JOIN tcolok USING (report, page_no, gx) JOIN trowok USING (report, page_no, gy)
),
tdims AS (
  SELECT report, page_no, max(col) AS max_col,
         min(CASE WHEN col > 0 AND text IS NOT NULL THEN rw END) AS a,
         max(CASE WHEN col > 0 AND text IS NOT NULL THEN rw END) + 1 AS b
  FROM tcells2 GROUP BY report, page_no
),
tdet0 AS (
  SELECT c.report, c.page_no, d.max_col, d.a, d.b,
         count(*) FILTER (WHERE c.rw >= d.a AND c.rw < d.b AND c.col > 0
                          AND regexp_matches(regexp_replace(c.text, '[, $()%]', '', 'g'), '{_NUM}')) AS n_num,
         max(CASE WHEN c.rw = d.a - 1 AND c.col = 0 THEN c.text END) AS h,
         min(CASE WHEN c.rw >= d.a AND c.rw < d.b THEN c.block_no END) AS block_a,
         max(CASE WHEN c.rw >= d.a AND c.rw < d.b THEN c.block_no END) AS block_b
  FROM tcells2 c JOIN tdims d USING (report, page_no) WHERE d.a IS NOT NULL
  GROUP BY c.report, c.page_no, d.max_col, d.a, d.b
),
tdet AS (
  SELECT report, page_no, a, b, max_col + 1 AS n_cols, CASE WHEN a = 0 THEN '' ELSE h END AS heading, block_a, block_b,
         n_num / ((b - a) * max_col) AS numeric_share
  FROM tdet0 WHERE max_col > 0 AND n_num / ((b - a) * max_col) > 0.2
),
tw AS (
  SELECT c.report, c.page_no, c.col, max(length(coalesce(c.text, ''))) + 2 AS w
  FROM tcells2 c JOIN tdet d USING (report, page_no) WHERE c.rw >= d.a AND c.rw < d.b GROUP BY ALL
),
tgrid AS (
  SELECT d.report, d.page_no, d.a, r.rw, k.col
  FROM tdet d
  JOIN (SELECT DISTINCT report, page_no, rw FROM tcells2) r ON r.report = d.report AND r.page_no = d.page_no AND r.rw >= d.a AND r.rw < d.b
  JOIN (SELECT report, page_no, unnest(range(n_cols)) AS col FROM tdet) k ON k.report = d.report AND k.page_no = d.page_no
),
tline AS (
  SELECT g.report, g.page_no, g.rw, any_value(g.a) AS a,
         '|' || string_agg(' ' || CASE WHEN g.col = 0 THEN rpad(coalesce(c.text, ''), CAST(w.w - 1 AS INTEGER), ' ')
                                       ELSE lpad(coalesce(c.text, ''), CAST(w.w - 1 AS INTEGER), ' ') END || '|', '' ORDER BY g.col)
           || chr(10) AS line,
         '|' || string_agg(' ' || repeat('-', CAST(w.w - 2 AS INTEGER)) || ' |', '' ORDER BY g.col) || chr(10) AS rule_
  FROM tgrid g
  LEFT JOIN tcells2 c ON c.report = g.report AND c.page_no = g.page_no AND c.rw = g.rw AND c.col = g.col
  JOIN tw w ON w.report = g.report AND w.page_no = g.page_no AND w.col = g.col
  GROUP BY g.report, g.page_no, g.rw
),
tmd AS (
  SELECT report, page_no, string_agg(CASE WHEN rw = a THEN line || rule_ ELSE line END, '' ORDER BY rw) AS markdown
  FROM tline GROUP BY report, page_no
)"""


TABLE_HTML = """
tnum AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY page_no) - 1 AS table_no FROM tdet),
thtml AS (
  SELECT t.report, t.page_no, t.block_a, t.block_b,
         chr(10) || '<b>Table ' || CAST(t.table_no AS VARCHAR) || ': ' || coalesce(t.heading, 'None') || '</b>' || chr(10) || chr(10)
         || chr(10) || '<div class="markdown-table">' || chr(10) || m.markdown || chr(10) || '</div>' || chr(10) AS th
  FROM tnum t JOIN tmd m USING (report, page_no)
)"""

DOC_TSP = """
tsp AS (SELECT report, page_key AS page_no, block_no, line_no, span_no, text, x0, y0, x1, y1 FROM ks)"""

FIX_DOCTAIL = """
dhtml AS (
  SELECT b.report, b.page_key, b.block_no, CASE WHEN b.block_no = t.block_a THEN t.th ELSE b.html END AS html
  FROM bhtml b LEFT JOIN thtml t ON t.report = b.report AND t.page_no = b.page_key
  WHERE t.block_a IS NULL OR NOT (b.block_no > t.block_a AND b.block_no < t.block_b)
),
bparts AS (
  SELECT report, page_key, block_no, unnest(range(len(parts))) AS j, unnest(parts) AS part,
         coalesce(sum(len(parts) - 1) OVER (PARTITION BY report ORDER BY page_key, block_no
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h1_before
  FROM (SELECT *, string_split(html, '<h1>') AS parts FROM dhtml)
),
dsec0 AS (
  SELECT report, h1_before + j AS i,
         regexp_replace(regexp_replace(string_agg(part, '' ORDER BY page_key, block_no, j), '\\r+\\n', chr(10), 'g'),
                        '\\n\\n\\n+', chr(10) || chr(10), 'g') AS raw
  FROM bparts GROUP BY report, h1_before + j
),
dsec AS (SELECT report, i, CASE WHEN contains(raw, '</h1>') THEN '<h1>' || raw ELSE raw END AS html FROM dsec0)"""

DOC_CTES = (FIX_DOCS, FIX_DOCFLOW, DOC_TSP, TABLE_FLOW, TABLE_HTML, FIX_DOCTAIL)



ORACLES["spans_flatten"] = with_(FIX_DOCS) + """
SELECT report, page_no, block_no::BIGINT AS block_no, line_no::BIGINT AS line_no, span_no::BIGINT AS span_no,
       text, font, round(size, 6) AS size, NULL::VARCHAR AS error FROM dsp
UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'JSONDecodeError'"""

ORACLES["page_split"] = with_(*DOC_CTES) + """
SELECT report, page_key::BIGINT AS page_key, block_no::BIGINT AS block_no, line_no::BIGINT AS line_no,
       span_no::BIGINT AS span_no, round(page_w, 6) AS page_w, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM sp2"""

ORACLES["boilerplate_keys"] = with_(*DOC_CTES) + "SELECT report, block_key, n FROM rep_keys"

ORACLES["boilerplate_remove"] = with_(*DOC_CTES) + """
SELECT report, page_key::BIGINT AS page_key, block_no::BIGINT AS block_no, n_lines::BIGINT AS n_lines,
       text_len::BIGINT AS text_len FROM kb"""

ORACLES["document_text"] = with_(*DOC_CTES) + """
SELECT report, n_blocks::BIGINT AS n_blocks, n_chars::BIGINT AS n_chars FROM dstat2"""

ORACLES["unreadable_share"] = with_(*DOC_CTES) + """
SELECT report, n_chars::BIGINT AS n_chars, n_private::BIGINT AS n_private, round(private_share, 6) AS private_share FROM dstat2"""

ORACLES["document_status"] = with_(*DOC_CTES) + "SELECT report, status FROM dstat2"

ORACLES["font_entries"] = with_(*DOC_CTES) + "SELECT report, font_key, pos::BIGINT AS pos, text FROM fent"

ORACLES["font_stats"] = with_(*DOC_CTES) + """
SELECT report, font_key, n_entries::BIGINT AS n_entries, text_len::BIGINT AS text_len, n_distinct::BIGINT AS n_distinct,
       round(mean_len, 6) AS mean_len, round(share, 6) AS share, round(start_, 6) AS start, round(end_, 6) AS "end"
FROM fst"""

ORACLES["body_font"] = with_(*DOC_CTES) + "SELECT report, body_font FROM bodyf"

ORACLES["heading_font"] = with_(*DOC_CTES) + "SELECT report, heading_font FROM headf"

ORACLES["heading_accept"] = "WITH RECURSIVE " + with_(*DOC_CTES)[5:] + """
SELECT report, page_key::BIGINT AS page_key, block_no::BIGINT AS block_no, line_no::BIGINT AS line_no,
       span_no::BIGINT AS span_no, plain_before::BIGINT AS plain_before, head_key, accepted FROM hacc"""

ORACLES["html_blocks"] = "WITH RECURSIVE " + with_(*DOC_CTES)[5:] + """
SELECT report, page_key::BIGINT AS page_key, block_no::BIGINT AS block_no, html FROM bhtml"""

ORACLES["document_sections"] = "WITH RECURSIVE " + with_(*DOC_CTES)[5:] + """
SELECT report, i::BIGINT AS i, length(html)::BIGINT AS n_chars, md5(html) AS md5 FROM dsec"""

ORACLES["html_document"] = "WITH RECURSIVE " + with_(*DOC_CTES)[5:] + """
SELECT report, n_tables, title, length(page)::BIGINT AS n_chars, md5(page) AS md5 FROM (
  SELECT report, report AS title, ((length(body) - length(replace(body, '<b>Table ', ''))) // 9)::BIGINT AS n_tables,
         '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<meta charset=\'\'utf-8\'\'><title>'
         || report || '</title>' || chr(10) || '<style>' || chr(10) || $css$""" + _CSS + """$css$ || chr(10) || '</style>'
         || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || body || $tail$""" + _TAIL + """$tail$ AS page
  FROM (SELECT report, regexp_replace(regexp_replace(string_agg(html, '' ORDER BY page_key, block_no), '\\r+\\n', chr(10), 'g'),
                                      '\\n\\n\\n+', chr(10) || chr(10), 'g') AS body FROM dhtml GROUP BY report))"""

ORACLES["sections"] = r"""
WITH src AS (
  SELECT CAST(page_id AS VARCHAR) AS doc, html FROM pages
  UNION ALL
  SELECT 'host:' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '#' || CAST(page_id // 500 AS VARCHAR), string_agg(html, '' ORDER BY page_id)
  FROM pages GROUP BY regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), page_id // 500
), parts AS (
  SELECT doc, unnest(range(len(ps))) AS i, unnest(ps) AS part FROM (SELECT doc, string_split(html, '<h1>') AS ps FROM src)
), s AS (SELECT doc, i, CASE WHEN contains(part, '</h1>') THEN '<h1>' || part ELSE part END AS html FROM parts)
SELECT doc, i::BIGINT AS i, length(html)::BIGINT AS n_chars, md5(html) AS md5 FROM s"""

# ------------------------------------------------------------ step 8: scoring and the result row


def _grade_sql(src: str, resp: str) -> str:
    """S13 branches over a response column, as (grade, answer) select items."""
    return f"""
  CASE WHEN strpos({resp}, ';') > 0 THEN
         (CASE WHEN regexp_matches(split_part({resp}, ';', 1), '^\\s*[+-]?\\d+\\s*$')
               THEN TRY_CAST(trim(split_part({resp}, ';', 1)) AS INTEGER) END)
       WHEN regexp_extract(substring({resp}, 1, 40), '\\b(\\d{{1,2}})\\b', 1) <> ''
         THEN TRY_CAST(regexp_extract(substring({resp}, 1, 40), '\\b(\\d{{1,2}})\\b', 1) AS INTEGER) END AS grade,
  CASE WHEN strpos({resp}, ';') > 0 THEN
         (CASE WHEN split_part({resp}, ';', 1) = 'None' OR regexp_matches(split_part({resp}, ';', 1), '^\\s*[+-]?\\d+\\s*$')
               THEN substring({resp}, strpos({resp}, ';') + 1) ELSE {resp} END)
       WHEN regexp_extract(substring({resp}, 1, 40), '\\b(\\d{{1,2}})\\b', 1) <> ''
         THEN substring({resp}, strpos({resp}, CAST(TRY_CAST(regexp_extract(substring({resp}, 1, 40), '\\b(\\d{{1,2}})\\b', 1) AS INTEGER) AS VARCHAR)) + 2)
       WHEN contains(substring({resp}, 1, 10), 'None') THEN substring({resp}, 6)
       ELSE {resp} END AS answer
  FROM {src}"""


FIX_SCORING = r"""
sprompt AS (
  SELECT report, i,
         '# Section ' || CAST(i AS VARCHAR) || ':' ||
           (CASE WHEN contains(html, '<h1>') THEN regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) ELSE '' END) AS heading,
         'Here is section ' || CAST(i + 1 AS VARCHAR) || ':' || chr(10) || substring(html, part * 120000 + 1, 120000) AS prompt,
         part, substring(html, part * 120000 + 1, 120000) AS body
  FROM (SELECT *, unnest(range((length(html) + 119999) // 120000)) AS part FROM dsec WHERE html <> '')
),
ssum AS (
  SELECT report, i, any_value(heading) AS heading,
         string_agg(trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')), ' ' ORDER BY part) AS res
  FROM sprompt GROUP BY report, i
),
sconc AS (
  SELECT report, summary,
         CAST(CAST(floor(10 * len(list_distinct(ws)) / greatest(len(ws), 1)) AS BIGINT) AS VARCHAR) || '; ' || summary AS resp
  FROM (SELECT *, list_filter(regexp_split_to_array(summary, '[ \n]+'), lambda w: w <> '') AS ws FROM (SELECT report, string_agg(heading || chr(10) || chr(10) || res || chr(10) || chr(10), '' ORDER BY i) AS summary
        FROM ssum WHERE res IS NOT NULL GROUP BY report))
)"""

_DOCS_SCORED = "WITH RECURSIVE " + with_(*DOC_CTES, FIX_SCORING)[5:]

ORACLES["section_prompts"] = _DOCS_SCORED + """
SELECT report, i::BIGINT AS i, part::INTEGER AS part, heading, length(prompt)::BIGINT AS n_chars, md5(prompt) AS md5 FROM sprompt"""

ORACLES["section_summaries"] = _DOCS_SCORED + "SELECT report, i::BIGINT AS i, heading, length(res)::BIGINT AS n_chars, md5(res) AS md5 FROM ssum"

ORACLES["summary_concat"] = _DOCS_SCORED + """
SELECT report, summary_md5, n_chars, grade, md5(answer) AS answer_md5 FROM (
SELECT report, md5(summary) AS summary_md5, length(summary)::BIGINT AS n_chars,""" + _grade_sql("sconc", "resp") + ")"

_RES_STATS = ", ".join(
    f"max(CASE WHEN horizon = {h} THEN {c} END) AS {c}_{h}"
    for h in (1, 2) for c in ["pval_alpha", "pval_beta", "alpha", "beta", "t_alpha", "t_beta"]
)

_RR_CTES = (
    "WITH RECURSIVE " + with_(*REPORT_CTES, *_gs_ctes(True))[5:].rstrip("\n") + _ols_select(True) + ",\n"
    + ",".join(c.strip("\n") for c in (*DOC_CTES, FIX_SCORING)) + f""",
st4 AS (
  SELECT *, {_tp('t_alpha', 'df')} AS pval_alpha, {_tp('t_beta', 'df')} AS pval_beta FROM st3
),
wide AS (SELECT path, {_RES_STATS} FROM st4 GROUP BY path),
gr AS (SELECT report AS doc, {_grade_sql("sconc", "resp").strip().split(" AS grade,")[0]} AS grade FROM sconc),
base AS (
  SELECT r.path, r.doc, r.isin, r.isin_db, n.name AS wname, w.*, coalesce(w.alpha_2 IS NOT NULL, FALSE) AS ok
  FROM res r LEFT JOIN wide w USING (path) LEFT JOIN (SELECT path, name FROM prof2 WHERE horizon = 1) n USING (path)
)
SELECT b.path, b.isin AS "ISIN", b.isin_db AS "ISIN_db", CASE WHEN ok THEN wname END AS "Name",
""" + ",\n".join(
        f"       round(CASE WHEN ok THEN {c}_{h} END, {8 if c.startswith('pval') else 6}) AS {c}_{h}"
        for h in (1, 2) for c in ["pval_alpha", "pval_beta", "alpha", "beta", "t_alpha", "t_beta"]
    ) + """,
       CASE WHEN ok AND pval_alpha_2 IS NOT NULL THEN g.grade END::INTEGER AS "Answer"
FROM base b LEFT JOIN gr g ON g.doc = b.doc"""
)
_RR_CTES, _RR_SELECT = _RR_CTES.split("\nSELECT b.path, b.isin", 1)
_RR_SELECT = "SELECT b.path, b.isin" + _RR_SELECT
ORACLES["report_result"] = _RR_CTES + "\n" + _RR_SELECT

# ------------------------------------------------------------ step 7: tables

FIX_TABLES = f"""
tcnt AS (SELECT l_orderkey AS page_no, count(*) AS n_items FROM lineitem GROUP BY l_orderkey),
titems AS (
  SELECT l_orderkey AS page_no, l_quantity, l_extendedprice, l_discount,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n
  FROM lineitem
),
tcells AS (
  SELECT page_no, n + 2 AS rw, 0 AS col, 'Item ' || CAST(n AS VARCHAR) AS text FROM titems
  UNION ALL SELECT page_no, n + 2, 1, CASE WHEN page_no % 20 = 0 THEN 'qty' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END FROM titems
  UNION ALL SELECT page_no, n + 2, 2, CASE WHEN page_no % 20 = 0 THEN 'price' ELSE format('{{:,.2f}}', l_extendedprice) END FROM titems
  UNION ALL SELECT page_no, n + 2, 3, CASE WHEN page_no % 20 = 0 THEN 'disc' WHEN page_no % 5 = 0 AND n = 1 THEN ''
                                           ELSE format('{{:.2f}}', l_discount) END FROM titems
  UNION ALL SELECT page_no, 0, 0, 'Lines' FROM tcnt
  UNION ALL SELECT page_no, 1, 0, 'Order lines ' || CAST(page_no AS VARCHAR) FROM tcnt
  UNION ALL SELECT page_no, 2, c, h FROM tcnt CROSS JOIN (VALUES (0, 'Line'), (1, 'Quantity'), (2, 'Price'), (3, 'Discount')) hd(c, h)
  UNION ALL SELECT page_no, n_items + 3, 0, 'End of page' FROM tcnt
),
tsp AS (
  SELECT 'T' || CAST(page_no % 20 AS VARCHAR) || '.' || CAST(page_no // 20000 AS VARCHAR) AS report, page_no, rw AS block_no, col AS line_no, 0 AS span_no, text,
         CASE WHEN col = 0 THEN 20.0 ELSE 150.0 + 100.0 * col - 5.0 * length(text) END AS x0,
         100.0 + 20.0 * rw AS y0,
         CASE WHEN col = 0 THEN 20.0 + 5.0 * length(text) ELSE 150.0 + 100.0 * col END AS x1,
         110.0 + 20.0 * rw AS y1
  FROM tcells
)"""

_TAB = with_(FIX_TABLES, TABLE_FLOW)

ORACLES["numeric_cells"] = _TAB + f"""
, lines AS (
  SELECT report, page_no, block_no, line_no, string_agg(' ' || text || ' ', '' ORDER BY span_no) AS plain FROM tsp GROUP BY ALL
)
SELECT report, page_no, block_no::BIGINT AS block_no, count(*)::BIGINT AS n_cells,
       count(*) FILTER (WHERE line_no > (SELECT min(l2.line_no) FROM lines l2 WHERE l2.report = lines.report
                                          AND l2.page_no = lines.page_no AND l2.block_no = lines.block_no)
                        AND regexp_matches(regexp_replace(plain, '[, ]', '', 'g'), '{_NUM}'))::BIGINT AS n_numeric
FROM lines GROUP BY report, page_no, block_no"""

ORACLES["table_extent"] = _TAB + "SELECT report, page_no, idx::BIGINT AS idx, text FROM tex"

ORACLES["interval_cover"] = _TAB + "SELECT report, page_no, axis, idx::BIGINT AS idx, c1::BIGINT AS cover FROM tcov1"

ORACLES["interval_groups"] = _TAB + "SELECT report, page_no, axis, round(coord, 6) AS coord, grp::BIGINT AS grp FROM tgrp"

ORACLES["table_cells"] = _TAB + """
SELECT report, page_no, rw::BIGINT AS "row", col::BIGINT AS col, text, block_no::BIGINT AS block_no FROM tcells2"""

ORACLES["table_detect"] = _TAB + """
SELECT report, page_no, a::BIGINT AS a, b::BIGINT AS b, n_cols::BIGINT AS n_cols, heading,
       block_a::BIGINT AS block_a, block_b::BIGINT AS block_b, round(numeric_share, 6) AS numeric_share FROM tdet"""

ORACLES["table_markdown"] = _TAB + """
SELECT report, page_no, length(markdown)::BIGINT AS n_chars, md5(markdown) AS md5 FROM tmd"""

ORACLES["table_insert"] = with_(FIX_TABLES, TABLE_FLOW, TABLE_HTML) + """
, blk AS (
  SELECT report, page_no, block_no, chr(10) || '<p>' || string_agg(' ' || text || ' ', '' ORDER BY line_no, span_no) || '</p>' AS html
  FROM tsp GROUP BY report, page_no, block_no
),
ins AS (
  SELECT b.report, b.page_no, b.block_no, CASE WHEN b.block_no = t.block_a THEN t.th ELSE b.html END AS html
  FROM blk b LEFT JOIN thtml t USING (report, page_no)
  WHERE t.block_a IS NULL OR NOT (b.block_no > t.block_a AND b.block_no < t.block_b)
)
SELECT report, page_no, length(pg)::BIGINT AS n_chars, md5(pg) AS md5
FROM (SELECT report, page_no, string_agg(html, '' ORDER BY block_no) AS pg FROM ins GROUP BY report, page_no)"""


# ------------------------------------------------------------ step 3: sinks and incremental

_RR = _RR_CTES + ",\nrr AS (" + _RR_SELECT + "),\nrry AS (SELECT *, TRY_CAST(string_split(string_split(path, '\\')[-1], '_')[1] AS INTEGER) AS year FROM rr)\n"

ORACLES["ledger_roundtrip"] = r"""
SELECT *, chr(32) || chr(9) || '"' || "Name" || '";' || chr(13) || chr(13) || '\ ''None'' ' || path || chr(9) || ' ' AS "Note"
FROM (""" + ORACLES["report_result"] + ")"

ORACLES["result_insert_absent"] = _RR + """
SELECT path, "ISIN", "ISIN_db", "Name", alpha_2, "Answer" FROM (
  SELECT *, row_number() OVER (PARTITION BY "ISIN" ORDER BY year, path) AS rn FROM rry) WHERE rn = 1"""

ORACLES["result_key_exists"] = _RR + """
SELECT path, "ISIN", "ISIN" IN (SELECT "ISIN" FROM rry WHERE year <= 1997) AS "exists" FROM rry"""

# Code, name, precision and length of the result table's types.
_TYPES = [(-9, "string", "NULL", "NULL")] * 3 + [(6, "double", 53, 8)] * 12 + [(4, "int", 10, 4)]
_COLS = ["ISIN", "ISIN_db", "Name"] + [f"{c}_{h}" for h in (1, 2) for c in
                                       ["pval_alpha", "pval_beta", "alpha", "beta", "t_alpha", "t_beta"]] + ["Answer"]
ORACLES["result_schema"] = _RR + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS ordinal, '{c}' AS column_name, {t[0]}::INTEGER AS data_type, '{t[1]}' AS type_name, "
    f"{t[2]}::INTEGER AS column_precision, {t[3]}::INTEGER AS column_length, count(\"{c}\")::BIGINT AS n_nonnull FROM rr"
    for i, (c, t) in enumerate(zip(_COLS, _TYPES))) + ")"

ORACLES["key_uniqueness"] = _RR + """
SELECT "ISIN", count(*)::BIGINT AS n FROM rr GROUP BY "ISIN" HAVING count(*) > 1"""

ORACLES["incremental_skip"] = ORACLES["document_sections"].replace("AS md5 FROM dsec", "AS md5, 1::BIGINT AS n_opened FROM dsec")

# Section 1 of the reports that the first run has seen, as it is before the third.
_REVISED = _DOCS_SCORED.replace("dsec AS (SELECT", "dsec1 AS (SELECT").replace("FROM dsec0)", """FROM dsec0),
dsec AS (
  SELECT report, i, CASE WHEN substring(md5(report), 1, 1) < '8' AND i = 1 AND html <> '' THEN html || ' Revised.' ELSE html END AS html
  FROM dsec1)""")

ORACLES["incremental_scores"] = _REVISED + """
SELECT r.report, CASE WHEN seen THEN n ELSE 0 END::BIGINT AS summaries_1, CASE WHEN seen AND n > 0 THEN 1 ELSE 0 END::BIGINT AS conclusions_1,
       CASE WHEN seen THEN 0 ELSE n END::BIGINT AS summaries_2, CASE WHEN NOT seen AND n > 0 THEN 1 ELSE 0 END::BIGINT AS conclusions_2,
       CASE WHEN seen THEN one ELSE 0 END::BIGINT AS summaries_3, CASE WHEN seen AND one > 0 THEN 1 ELSE 0 END::BIGINT AS conclusions_3,
       md5(summary) AS summary_md5
FROM (SELECT report, substring(md5(report), 1, 1) < '8' AS seen, count(*) FILTER (WHERE html <> '') AS n, count(*) FILTER (WHERE html <> '' AND i = 1) AS one
      FROM dsec GROUP BY report) r LEFT JOIN sconc USING (report)"""
