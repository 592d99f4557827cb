"""Scalar string functions of the trace reports, as Spark column expressions.

All of them are built from JVM-side functions (regexp, substring_index, CASE), so they stay inside
whole-stage codegen; none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions import variant as V

# ---------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Symbol literals scanned in this order (first hit wins): "SYM_" / "SYM-" substring, then \bSYM\b.
SYMBOL_LITERALS = [
    "BTC", "BITCOIN", "ETH", "ETHEREUM", "SOL", "SOLANA", "DOGE", "DOGECOIN", "ADA", "CARDANO",
    "DOT", "POLKADOT", "MATIC", "POLYGON", "AVAX", "AVALANCHE", "LINK", "CHAINLINK", "XRP",
    "RIPPLE", "BNB", "BINANCE", "USDC", "USDT",
]
# Substring families tried after the literals, in this order: symbol -> substrings.
SYMBOL_FAMILIES = [
    ("BNB", ["bnb", "binance"]),
    ("ETH", ["ethereum", "eth"]),
    ("BTC", ["bitcoin", "btc"]),
    ("SOL", ["solana", "sol"]),
    ("DOGE", ["doge", "shiba", "inu"]),
    ("MATIC", ["polygon", "matic"]),
    ("ADA", ["cardano", "ada"]),
]
UNKNOWN_SYMBOL = "Unknown"
UNKNOWN_ERROR = "Unknown error"
# ---------------------------------------------------------------------------------------------

_WS = r"(?U)^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pystrip(x) -> Column:
    """Python ``str.strip()`` (Unicode whitespace on both ends)."""
    return F.regexp_replace(_c(x), _WS, "")


def contains(x, lit: str) -> Column:
    return F.instr(_c(x), lit) > 0


# --------------------------------------------------------------------------------- P4a / P4b
def is_rate_error(name, status) -> Column:
    """lower(name) contains 'zenrows_scraper' and lower(status) = 'error' (null-safe)."""
    return F.coalesce(contains(F.lower(_c(name)), "zenrows_scraper")
                      & (F.lower(_c(status)) == "error"), F.lit(False))


def is_detail_error(name, status) -> Column:
    """lower(name) contains 'zenrows' or 'scraper', and lower(status) = 'error' (null-safe)."""
    n = F.lower(_c(name))
    return F.coalesce((contains(n, "zenrows") | contains(n, "scraper"))
                      & (F.lower(_c(status)) == "error"), F.lit(False))


# --------------------------------------------------------------------------------- P13 symbol
def symbol_text_scan(name, error) -> Column:
    """Text-scan part of P13 on ``upper(str(name) + ' ' + str(error))``.

    A present-but-null name/error renders as ``None`` (Python f-string), which is what the run
    table stores: every run document carries both keys. One alternation of all literals and substrings comes
    first, since every rule needs one of them: texts without any are done. Likewise a literal's patterns are tried
    only where the literal is.
    """
    t = F.upper(F.concat(F.coalesce(_c(name), F.lit("None")), F.lit(" "),
                         F.coalesce(_c(error), F.lit("None"))))
    any_word = sorted({s for s in SYMBOL_LITERALS} | {p.upper() for _, pats in SYMBOL_FAMILIES for p in pats})
    first = "".join(sorted({w[0] for w in any_word}))  # most places of a text are passed by their first letter
    expr = F.when(~t.rlike(f"(?=[{first}])(?:{'|'.join(any_word)})"), F.lit(UNKNOWN_SYMBOL))
    for sym in SYMBOL_LITERALS:
        cond = contains(t, sym) & (contains(t, sym + "_") | contains(t, sym + "-") | t.rlike(r"(?U)\b" + sym + r"\b"))
        expr = expr.when(cond, F.lit(sym))
    for sym, pats in SYMBOL_FAMILIES:
        cond = None
        for p in pats:
            c = contains(t, p.upper())
            cond = c if cond is None else (cond | c)
        expr = expr.when(cond, F.lit(sym))
    return expr.otherwise(F.lit(UNKNOWN_SYMBOL))


def crypto_symbol(doc, name, error) -> Column:
    """Inputs.input_data.crypto_symbol -> input_data.name (<=10 alnum) -> metadata.symbol
    -> extra.crypto -> text scan of name + error -> 'Unknown'.

    ``doc`` may be None when only the typed columns exist (no free-form inputs)."""
    scan = symbol_text_scan(name, error)
    if doc is None:
        return scan
    # a path through what is no object leads nowhere, so members are read by their paths, without those above them
    cs = V.as_string(doc, "$.inputs.input_data.crypto_symbol")
    nm = V.as_string(doc, "$.inputs.input_data.name")
    nm_clean = F.upper(pystrip(nm))
    meta_sym = V.as_string(doc, "$.metadata.symbol")
    extra_crypto = V.as_string(doc, "$.extra.crypto")
    return (F.when(F.length(cs) > 0, F.upper(cs))
            .when((F.length(nm) > 0) & (F.length(nm_clean) <= 10)
                  & nm_clean.rlike(r"^[\p{L}\p{N}]+$"), nm_clean)
            .when(F.length(meta_sym) > 0, F.upper(meta_sym))
            .when(F.length(extra_crypto) > 0, F.upper(extra_crypto))
            .otherwise(scan))


def target_url(doc) -> Column:
    """First truthy of inputs.input / inputs.url / inputs.target_url (string values)."""
    if doc is None:
        return F.lit(None).cast("string")

    def pick(k):
        s = V.sub(doc, "$.inputs." + k)
        return F.when(V.truthy(s), F.coalesce(V.as_string(s), F.to_json(s)))
    return F.coalesce(pick("input"), pick("url"), pick("target_url"))


# --------------------------------------------------------------------------------- F3
def clean_error(e) -> Column:
    """reduce an error text (with stack trace) to its essential line.

    HTTPError('<status> for url: <url>')Traceback...  -> '<status> - <netloc of url before &>'
    '...Error: ...' with a Traceback                -> first line with Error:/Exception:/Timeout
    ReadTimeout / 'timeout'                          -> 'Request timeout'
    longer than 150 characters                       -> first 147 + '...'
    """
    e = _c(e)
    http_part = F.concat(F.substring_index(e, "')Traceback", 1), F.lit("')"))
    after = F.try_element_at(F.split(http_part, r"HTTPError\('"), F.lit(2))
    error_text = F.regexp_replace(after, r"['\)]+\z", "")
    status_part = F.substring_index(error_text, " for url: ", 1)
    url_part = F.substring(error_text, F.instr(error_text, " for url: ") + 10, 1 << 30)
    netloc = F.regexp_extract(F.substring_index(url_part, "&", 1),
                              r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    http_ok = contains(e, "HTTPError(") & contains(e, "')Traceback") & contains(http_part, "HTTPError('")
    first_err_line = F.try_element_at(
        F.filter(F.split(e, "\n"),
                 lambda ln: contains(ln, "Error:") | contains(ln, "Exception:") | contains(ln, "Timeout")), F.lit(1))
    return (F.when(e.isNull() | (F.length(e) == 0), F.lit(UNKNOWN_ERROR))
            .when(http_ok & contains(error_text, " for url: "),
                  F.concat(status_part, F.lit(" - "), netloc))
            .when(http_ok, error_text)
            .when(contains(e, "Error:") & contains(e, "Traceback") & first_err_line.isNotNull(),
                  pystrip(first_err_line))
            .when(contains(e, "ReadTimeout") | contains(F.lower(e), "timeout"), F.lit("Request timeout"))
            .when(F.length(e) > 150, F.concat(F.substring(e, 1, 147), F.lit("...")))
            .otherwise(e))


# --------------------------------------------------------------------------------- F1 / F2
def normalize_url(u) -> Column:
    """lower(strip(u)); drop one 'https://' or 'http://', one 'www.', one trailing '/'."""
    n = F.lower(pystrip(F.coalesce(_c(u), F.lit(""))))
    n = F.regexp_replace(n, r"^https?://", "")
    n = F.regexp_replace(n, r"^www\.", "")
    return F.regexp_replace(n, r"/\z", "")


def url_domain(u) -> Column:
    """domain for diversity grouping; case-sensitive protocol test, 'unknown' if no dot."""
    u = _c(u)
    full = F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))
    net = F.lower(F.regexp_extract(full, r"^https?://([^/?#]*)", 1))
    host = F.substring_index(net, ":", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return (F.when(u.isNull(), F.lit("unknown"))
            .when((F.length(net) == 0) | ~contains(net, "."), F.lit("unknown"))
            .when(F.length(host) == 0, F.lit("unknown"))
            .otherwise(host))


# --------------------------------------------------------------------------------- F4
def quality_tenths(url, is_available, notes) -> Column:
    """F4 quality score in integer tenths (10 url, 10 flag, 5 long note, 3 success, 2 failure words)."""
    n = F.coalesce(_c(notes), F.lit(""))
    nl = F.lower(n)
    return (F.when(F.length(F.coalesce(_c(url), F.lit(""))) > 0, 10).otherwise(0)
            + F.when(_c(is_available).isNotNull(), 10).otherwise(0)
            + F.when(F.length(pystrip(n)) > 10, 5).otherwise(0)
            + F.when(contains(nl, "success") | contains(nl, "completed") | contains(nl, "found"), 3).otherwise(0)
            + F.when(contains(nl, "error") | contains(nl, "failed") | contains(nl, "timeout"), 2).otherwise(0))


# --------------------------------------------------------------------------------- F5 / F10
def date_key(start_time_str) -> Column:
    """date key = text before 'T' (after dropping 'Z') or before the first space."""
    s = _c(start_time_str)
    return F.when(contains(s, "T"), F.substring_index(F.regexp_replace(s, "Z", ""), "T", 1)) \
        .otherwise(F.substring_index(s, " ", 1))


def sanitize_project(p) -> Column:
    """keep letters, digits and '-_.'; null project -> 'unknown-project'."""
    return F.when(_c(p).isNull() | (F.length(_c(p)) == 0), F.lit("unknown-project")) \
        .otherwise(F.regexp_replace(_c(p), r"[^\p{L}\p{N}._\-]", ""))


# --------------------------------------------------------------------------------- A4
def round1(x) -> Column:
    """Python ``round(x, 1)`` (half-even on the exact binary value) via DecimalFormat."""
    return F.call_function("format_number", _c(x), F.lit("0.0")).cast("double")


def error_rate(errors, traces) -> Column:
    """A4: round((errors / traces) * 100, 1); 0.0 when there are no traces."""
    return F.when(_c(traces) == 0, F.lit(0.0)).otherwise(
        round1((_c(errors) / _c(traces)) * F.lit(100)))
