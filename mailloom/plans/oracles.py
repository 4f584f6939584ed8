"""SQL for DuckDB that gives the same rows as the core queries, over whole tables."""

from __future__ import annotations

import unicodedata

from mailloom.functions import timestamps
from mailloom.functions.domains import SUFFIXES
from mailloom.operators import confusables, explain, reasons, urls, wording
from mailloom.operators.identity import BRANDS as KNOWN
from mailloom.operators.identity import FREEMAIL as FREE
from mailloom.operators.reviewer import _HEAD, _INSTRUCTIONS, MODELS

FREEMAIL = "('co.example', 'havurship-desk.test', 'ildonpay.invalid', 'maribank.example', 'ulmamart-desk.test')"
WHITELIST = "('co.example', 'holuvor-office.example')"
_q = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_s = lambda text: "'" + text.replace("'", "''") + "'"


def addr(x: str) -> str:
    return rf"""coalesce(nullif(regexp_extract({x}, '<\s*([^<>@\s]+@[^<>@\s]+?)\s*>', 1), ''), nullif(regexp_extract({x}, '([^\s<>()\[\],;:"]+@[^\s<>()\[\],;:"@]+)', 1), ''))"""


def strip(x: str) -> str:
    t = f"lower(trim({x}, ' \t\r\n'))"
    return f"nullif(CASE WHEN {t} LIKE '[%' AND {t} LIKE '%]' THEN substr({t}, 2, length({t}) - 2) ELSE trim(split_part({t}, ':', 1), '.') END, '')"


def host(a: str) -> str:
    return f"CASE WHEN contains({a}, '@') THEN {strip(f'substr({a}, instr({a}, chr(64)) + 1)')} END"


def reg(h: str) -> str:
    """Of a host that is stripped already."""
    tail = lambda n: f"array_to_string(string_split({h}, '.')[-{n}:], '.')"
    return f"CASE WHEN regexp_full_match({h}, '[0-9.]+') OR len(string_split({h}, '.')) <= 2 THEN {h} WHEN {tail(2)} IN ({_q(SUFFIXES)}) THEN {tail(3)} ELSE {tail(2)} END"


_LINK = r"https?://[^\s\p{Z}\x0b\x1c-\x1f\x{85}]+|www\.[^\s\p{Z}\x0b\x1c-\x1f\x{85}]+"
#: a: addresses of every message; h: their hosts; m: their hosts and registrable domains
M = f"""a AS (SELECT *, {addr("from_addr")} AS fa, {addr("reply_to")} AS ra, {addr("return_path")} AS pa FROM parse_eml),
h AS (SELECT *, {host("fa")} AS fh, {host("ra")} AS rh, {host("pa")} AS ph FROM a),
m AS (SELECT *, {reg("fh")} AS fd, {reg("rh")} AS rd, {reg("ph")} AS pd, coalesce(subject, '') || ' ' || coalesce(body, '') AS txt FROM h)"""
_hit = lambda p: f"regexp_extract(txt, '(?i){p}', 0)"
LEX = "least(4, " + " + ".join(f"CASE WHEN {_hit(p)} <> '' THEN {w} ELSE 0 END" for p, w, _ in wording.LEXICON) + ")"
LABELS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_hit(p)} <> '' THEN {_s(label)} END" for p, _, label in wording.LEXICON) + "], lambda x: x IS NOT NULL), ', ')"


def _place(p: str) -> str:
    k, s, b = f"lower({_hit(p)})", "lower(coalesce(subject, ''))", "lower(coalesce(body, ''))"
    return f"CASE WHEN {k} = '' THEN 0 WHEN contains({s}, {k}) THEN 3 WHEN contains(substr({b}, 1, 400), {k}) THEN 2 WHEN contains(substr({b}, 401), {k}) THEN 1 ELSE 0 END"


POS = " + ".join(_place(p) for p, _, _ in wording.LEXICON)
_count = lambda t, words: " + ".join(f"contains({t}, '{w}')::INT" for w in words)


def cred(path: str, query: str) -> str:
    t = f"lower(concat_ws(' ', nullif({path}, ''), nullif({query}, '')))"
    n, k = f"({_count(t, urls.PRIMARY)})", f"({_count(t, urls.SECONDARY)})"
    return f"CASE WHEN {n} = 0 THEN 0 ELSE 1 + least({n} - 1, 1) + least({k}, 1) END"


def tld(h: str) -> str:
    return f"coalesce(regexp_matches({h}, '(" + "|".join(t.replace(".", "[.]") for t in urls.RISKY_TLDS) + ")$'), false)"


def short(h: str) -> str:
    return f"coalesce({h} IN ({_q(urls.SHORTENERS)}), false)"


def risk(h: str, base: str, own: str) -> str:
    """h: host, base: its registrable domain, own: the sender's registrable domain."""
    return (
        f"CASE WHEN coalesce({h}, '') = '' OR {base} IN ({_q(urls.WHITELIST + urls.TRUSTED_CONTENT)}) THEN 0 WHEN {base} = {own} OR suffix({h}, {own}) THEN 0 "
        f"WHEN regexp_matches({h}, '[0-9]{{3,}}') OR length({h}) - length(replace({h}, '-', '')) >= 2 OR {h} LIKE 'xn--%' OR length({h}) - length(replace({h}, '.', '')) >= 3 THEN 2 WHEN {own} IS NOT NULL THEN 1 ELSE 0 END"
    )


def judged(source: str) -> str:
    """CTEs: f (links, first of each), j (their points), k (their score and applied points). source: email_id, pos, url, scheme, host, path, query_str."""
    return f"""f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email_id, coalesce(scheme, ''), coalesce(host, ''), coalesce(path, ''), coalesce(query_str, '') ORDER BY pos, url) AS n FROM {source}) WHERE n = 1),
o AS (SELECT f.email_id, pos, url, f.host, f.path, f.query_str, {strip("f.host")} AS hs, m.fd FROM f LEFT JOIN m ON m.email_id = f.email_id),
o2 AS (SELECT *, {reg("hs")} AS base FROM o),
j AS (SELECT *, {risk("host", "base", "fd")} AS d, {tld("host")} AS t, {short("host")} AS s, {cred("path", "query_str")} AS c FROM o2),
j2 AS (SELECT *, CAST(least(6, d + CASE WHEN t THEN 2 ELSE 0 END + CASE WHEN s THEN 2 ELSE 0 END + c) AS INT) AS score FROM j),
k AS (SELECT *, CAST(least(least(score, 4), 8 - least(8, coalesce(sum(least(score, 4)) OVER (PARTITION BY email_id ORDER BY pos, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS INT) AS applied FROM j2 WHERE score > 0)"""


EXPLODED = rf"""x0 AS (SELECT email_id, regexp_extract_all(body, '{_LINK}') AS l FROM parse_eml WHERE body IS NOT NULL),
x AS (SELECT email_id, unnest(range(len(l))) AS pos, unnest(l) AS url FROM x0),
x2 AS (SELECT *, regexp_matches(url, '^https?://') AS fu, regexp_extract(url, '^https?://([^/?#]*)', 1) AS nl FROM x),
body_urls AS (SELECT email_id, CAST(pos AS INT) AS pos, url, CASE WHEN fu THEN regexp_extract(url, '^(https?)', 1) ELSE '' END AS scheme,
 CASE WHEN fu THEN translate(lower(regexp_extract(regexp_extract(nl, '([^@]*)$', 1), '^(\[[^\]]*\]|[^:]*)', 1)), '[]', '') ELSE '' END AS host,
 regexp_replace(CASE WHEN fu THEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) ELSE regexp_extract(url, '^([^?#]*)', 1) END, ';[^/]*$', '') AS path,
 regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query_str FROM x2 WHERE contains(nl, '[') = contains(nl, ']'))"""
# runs of as many words as the brand has, or the brand within the text
BRANDS = f"""bt AS (SELECT email_id, trim(regexp_replace(lower(txt), '[^a-z0-9]+', ' ', 'g')) AS t FROM m WHERE fd IN {FREEMAIL}),
bw AS (SELECT *, string_split(t, ' ') AS w FROM bt),
bb AS (SELECT *, trim(regexp_replace(b, '[^a-z0-9]+', ' ', 'g')) AS q, len(string_split(trim(regexp_replace(b, '[^a-z0-9]+', ' ', 'g')), ' ')) AS n FROM (SELECT DISTINCT lower(brand_name) AS b FROM known_brands)),
bm AS (SELECT DISTINCT email_id, b FROM bw, bb WHERE q <> '' AND (contains(t, q) OR len(list_filter(list_transform(range(1, greatest(len(w) - n + 2, 2)), lambda i: array_to_string(w[i:i + n - 1], ' ')),
 lambda x: abs(length(x) - length(q)) <= 1 AND levenshtein(x, q) <= 1)) > 0))"""
ODD_MSGID = "nullif(regexp_extract(message_id, '@([\\pL\\pN_.-]+)', 1), '')"
SCORED = f"""{M}, {EXPLODED}, {judged("body_urls")}, {BRANDS},
u AS (SELECT email_id, sum(applied) AS up FROM k GROUP BY 1), b AS (SELECT email_id, 2 AS bp FROM bm GROUP BY 1), mi AS (SELECT email_id, {strip(ODD_MSGID)} AS mh FROM m),
md AS (SELECT email_id, {reg("mh")} AS mdom FROM mi),
p AS (SELECT m.email_id, m.file, m.fd, CASE WHEN rd <> fd THEN 3 ELSE 0 END + CASE WHEN pd <> fd THEN 2 ELSE 0 END + CASE WHEN regexp_matches(fh, '[^\\x00-\\x7f]|xn--') THEN 3 ELSE 0 END + coalesce(bp, 0)
 + CASE WHEN len(received) > 5 OR len(list_filter(received, lambda r: length(r) > 1000)) > 0 THEN 2 ELSE 0 END + CASE WHEN mdom <> fd THEN 1 ELSE 0 END
 + {LEX} + {POS} + coalesce(up, 0) + CASE WHEN regexp_matches(lower(attachments), '[.](exe|scr|pif)$') THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches(lower(attachments), '[.](zip|rar|7z)$') AND length(attachments) > 100 THEN 2 ELSE 0 END AS raw
 FROM m LEFT JOIN u ON u.email_id = m.email_id LEFT JOIN b ON b.email_id = m.email_id LEFT JOIN md ON md.email_id = m.email_id),
z AS (SELECT email_id, file, fd, CAST(CASE WHEN fd IN {WHITELIST} AND raw > 0 THEN greatest(0, raw - 4) ELSE raw END AS INT) AS score FROM p),
sc AS (SELECT *, CASE WHEN score >= 10 THEN 'HIGH' WHEN score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM z)"""
PERCENT = "CAST(CASE WHEN score <= 1 THEN greatest(score, 0) * 100.0 ELSE least(score * 10.0, 100.0) END AS DOUBLE)"
_by = lambda texts: "CASE label " + " ".join(f"WHEN '{k}' THEN {_s(v)}" for k, v in texts.items()) + " END"
_TRAIN = "t AS (SELECT *, lower(trim(label)) AS l FROM training WHERE lower(trim(label)) IN ('spam', 'ham') AND text IS NOT NULL)"


# hosts as they look: presentation forms in plain letters, then look-alikes, then without accents
_FORMS = {c: p for c in map(chr, [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]) if len(p := unicodedata.normalize("NFKC", c).lower()) == 1 and p.isascii() and p.isalnum()}
_LOOKS = {chr(o): text for text, points in confusables.LOOKALIKES.items() if len(text) == 1 for o in points}
_ZERO = "[" + "".join(f"\\x{{{o:04X}}}" for o in confusables.ZERO_WIDTH) + "]"


def conf(h: str) -> str:
    """Why a host is suspicious; needs a CTE kb(k) of the known domains."""
    form = f"translate(lower({h}), '{''.join(_FORMS)}', '{''.join(_FORMS.values())}')"
    look = f"strip_accents(translate({form}, '{''.join(_LOOKS)}', '{''.join(_LOOKS.values())}'))"
    odd = f"regexp_matches({h}, '[^\\x00-\\x7f]')"
    return (
        f"CASE WHEN contains({h}, 'xn--') THEN 'punycode label' WHEN regexp_matches({h}, '{_ZERO}') THEN 'zero-width characters' "
        f"WHEN {look} <> {h} AND {look} IN (SELECT k FROM kb) THEN 'confusable match for ' || {look} "
        f"WHEN {odd} AND {look} <> regexp_replace({form}, '[^\\x00-\\x7f]', '', 'g') THEN 'confusable skeleton ' || {look} WHEN {odd} THEN 'non-ascii characters' END"
    )


KB = "kb AS (SELECT lower(brand_domain) AS k FROM known_brands WHERE brand_domain <> '')"
_REASONS = """array_to_string(list_filter([CASE d WHEN 2 THEN 'Unfamiliar domain structure' WHEN 1 THEN 'Domain differs from sender' END,
 CASE WHEN t THEN 'High-risk TLD' END, CASE WHEN s THEN 'URL shortener' END, CASE WHEN c > 0 THEN 'Credential-related terms in URL' END], lambda x: x IS NOT NULL), '; ')"""


def _fill(template: str, parts: list[str]) -> str:
    return " || ".join(f"({parts[x]})" if isinstance(x, int) else _s(x) for x in reasons.pieces(template) if x != "")


def _line(kind: str, points: str, *parts: str) -> str:
    word = "' points: '" if kind in reasons.PLURAL else f"CASE WHEN {points} = 1 THEN ' point: ' ELSE ' points: ' END"
    return f"CASE WHEN {points} > 0 THEN '+' ELSE '' END || {points} || {word} || {_fill(reasons.TEXTS[kind], list(parts))}"


def _told(kind: str, points: str, *parts: str) -> str:
    known = explain.DEFAULTS.get(kind, [])
    full = [f"coalesce(nullif(trim({p}), ''), {_s(known[i] if i < len(known) else '')})" for i, p in enumerate(parts)]
    n = f"abs({points})"
    return f"{n} || CASE WHEN {n} = 1 THEN '-point ' ELSE '-points ' END || CASE WHEN {points} > 0 THEN 'indicator: ' ELSE 'mitigation: ' END || {_fill(explain.SENTENCES[kind].rstrip('. ') + '. Action: ' + explain.ACTIONS[kind], full)}"


def _place_of(p: str) -> tuple[str, str]:
    k, s, b = f"lower({_hit(p)})", "lower(coalesce(subject, ''))", "lower(coalesce(body, ''))"
    return _place(p), f"CASE WHEN contains({s}, {k}) THEN 'subject' WHEN contains(substr({b}, 1, 400), {k}) THEN 'early body' ELSE 'body' END"


def _found() -> list[tuple[str, str, str, list[str]]]:
    """(condition, kind, points, parts) of the reasons before the links."""
    out = [
        ("rd <> fd", "reply_to", "3", ["rd"]), ("pd <> fd", "return_path", "2", ["pd"]), ("cr IS NOT NULL", "confusable", "3", ["cr", "fh"]), ("br IS NOT NULL", "freemail", "2", ["fd", "br"]),
        ("rr IS NOT NULL", "received", "2", ["rr"]), ("mdom <> fd", "message_id", "1", ["mdom"]), ("lex > 0", "phrases", "lex", ["labels"]),
    ]
    for p, _, _ in wording.LEXICON:
        points, where = _place_of(p)
        out.append((f"{points} > 0", "place", f"({points})", [_hit(p), where]))
    return out


_BAD = "regexp_matches(lower(attachments), '[.](exe|scr|pif)$')"
_ODD = "regexp_matches(lower(attachments), '[.](zip|rar|7z)$') AND length(attachments) > 100"


def _listed(text) -> str:
    """The reasons of a message as a list of texts."""
    before = ", ".join(f"CASE WHEN {cond} THEN {text(kind, points, *parts)} END" for cond, kind, points, parts in _found())
    links = "ll" if text is _line else "lt"
    after = f"CASE WHEN {_BAD} THEN {text('attachment', '4', 'attachments')} END, CASE WHEN {_ODD} THEN {text('archive', '2', 'attachments')} END, CASE WHEN fd IN {WHITELIST} AND raw > 0 THEN {text('whitelist', '-4', 'fd')} END"
    return f"list_filter(list_concat(list_concat([{before}], coalesce({links}, [])), [{after}]), lambda x: x IS NOT NULL)"


#: Per message its score and label, `ex`: its reasons as lines, `hu`: as sentences, `us`: its risky links
EXPLAINED = f"""{SCORED}, {KB},
la AS (SELECT email_id, list({_line("link", "applied", "url", "rs")} ORDER BY pos, url) FILTER (applied > 0) AS ll, list({_told("link", "applied", "url", "rs")} ORDER BY pos, url) FILTER (applied > 0) AS lt,
 list(url ORDER BY pos, url) AS us, list(url || chr(1) || rs ORDER BY pos, url) AS mk FROM (SELECT *, {_REASONS} AS rs FROM k) GROUP BY 1),
ba AS (SELECT email_id, string_agg(b, ', ' ORDER BY b) AS br FROM bm GROUP BY 1),
w0 AS (SELECT m.*, ll, lt, us, mk, br, mdom, raw, sc.score, sc.label, {conf("m.fh")} AS cr, {LEX} AS lex, {LABELS} AS labels,
 CASE WHEN len(received) > 5 THEN len(received) || ' headers (>5)' WHEN len(list_filter(received, lambda r: length(r) > 1000)) > 0 THEN len(list_filter(received, lambda r: length(r) > 1000)) || ' header(s) with length >1000' END AS rr,
 list_filter([{", ".join(f"nullif({_hit(p)}, '')" for p, _, _ in wording.LEXICON)}], lambda x: x IS NOT NULL) AS kw
 FROM m JOIN sc ON sc.email_id = m.email_id JOIN p ON p.email_id = m.email_id LEFT JOIN la ON la.email_id = m.email_id LEFT JOIN ba ON ba.email_id = m.email_id LEFT JOIN md ON md.email_id = m.email_id),
w1 AS (SELECT *, {_listed(_line)} AS ex, {_listed(_told)} AS hu FROM w0)"""
_once = lambda x: f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"
_SUMMARY = f"""{_by(explain.SEVERITY)} || ': composite score ' || score || '. ' || {_by(explain.GUIDANCE)} || CASE WHEN len(kw) > 0 THEN ' Flagged keywords: ' || array_to_string(({_once("kw")})[1:3], ', ') || '.' ELSE '' END"""
READABLE = f"""WITH {EXPLAINED},
w2 AS (SELECT *, CASE WHEN len(hu) > 0 THEN hu ELSE [CASE WHEN label = 'LOW' THEN {_s(explain.NOTHING_LOW)} ELSE {_s(explain.NOTHING_ELSE)} END] END AS de,
 CASE WHEN label = 'LOW' THEN [] ELSE list_filter(list_concat(list_concat([{_s(explain.NEXT_VERIFY)}], list_transform({_once("coalesce(us, [])")}, lambda u: 'Next step: Do not visit ' || u || '; navigate to the destination using a bookmark or manually typed address instead.')),
 [CASE WHEN len(list_filter(ex, lambda x: contains(lower(x), 'attachment'))) > 0 THEN CASE WHEN attachments <> '' THEN 'Next step: Delete or quarantine attachments (' || attachments || ') until security confirms they are safe.' ELSE {_s(explain.NEXT_ATTACHMENTS)} END END,
 CASE WHEN label = 'HIGH' THEN {_s(explain.NEXT_REPORT)} END]), lambda x: x IS NOT NULL) END AS ge FROM w1),
w3 AS (SELECT *, list_filter(list_concat(list_transform(de, lambda x: rtrim(trim(regexp_extract(x, '(?s)Action:(.*)$', 1)), '. ')), list_transform(ge, lambda x: rtrim(trim(regexp_replace(x, '^Next step:', '')), '. '))), lambda x: x <> '') AS it0 FROM w2),
w4 AS (SELECT *, {_once("it0")} AS it, list_concat([{_SUMMARY}], de) AS hd FROM w3)
SELECT email_id, label, array_to_string(list_concat(list_concat(hd, list_filter(ge, lambda g: NOT list_contains(hd, g))), CASE WHEN label <> 'LOW' AND len(it) > 0 THEN ['Action checklist: ' || array_to_string(it[1:4], '; ') || CASE WHEN len(it) > 4 THEN '; ...' ELSE '' END || '.'] ELSE [] END), chr(10)) AS told FROM w4"""
STUB = "least(95, 20 * (" + " + ".join(f"contains(lower(coalesce(body, '')), '{w}')::INT" for w in ("urgent", "password", "verify", "login", "confirm account")) + "))"
_json = lambda c: f"""'"{c}":' || to_json({c})::VARCHAR"""

ORACLES: dict[str, str] = {
    "sender_domains": f"WITH {M} SELECT email_id, fh AS host, fd AS domain FROM m WHERE fh IS NOT NULL",
    "replyto_mismatch": f"WITH {M} SELECT email_id, rd AS domain FROM m WHERE rd <> fd",
    "returnpath_mismatch": f"WITH {M} SELECT email_id, pd AS domain FROM m WHERE pd <> fd",
    "msgid_domain_mismatch": f"WITH {M}, i AS (SELECT email_id, fd, {strip(ODD_MSGID)} AS mh FROM m), r AS (SELECT email_id, fd, {reg('mh')} AS domain FROM i) SELECT email_id, domain FROM r WHERE domain <> fd",
    "received_anomaly": """SELECT * FROM (SELECT email_id, CASE WHEN len(received) > 5 THEN len(received) || ' headers (>5)'
 WHEN len(list_filter(received, lambda r: length(r) > 1000)) > 0 THEN len(list_filter(received, lambda r: length(r) > 1000)) || ' header(s) with length >1000' END AS reason FROM parse_eml) WHERE reason IS NOT NULL""",
    "freemail_brand_mention": f"WITH {M}, {BRANDS} SELECT email_id, string_agg(b, ', ' ORDER BY b) AS brands FROM bm GROUP BY 1",
    "fuzzy_domain_match": f"""WITH {M}, hh AS (SELECT DISTINCT host, trim(lower(trim(host)), '.') AS t FROM (SELECT host FROM email_urls UNION ALL SELECT fh FROM m UNION ALL SELECT rh FROM m) WHERE host <> ''), b AS (SELECT DISTINCT trim(lower(trim(brand_domain)), '.') AS k FROM known_brands WHERE brand_domain <> '')
SELECT host, string_agg(k, ', ' ORDER BY k) AS matches FROM hh, b WHERE t = k OR suffix(t, '.' || k) OR (abs(length(t) - length(k)) <= 1 AND levenshtein(t, k) <= 1) GROUP BY 1""",
    "brand_list": "WITH n AS (SELECT arg_min(lower(trim(brand_name)), ord) AS v FROM known_brands GROUP BY substr(lower(brand_name), 1, 1)), k(n, d) AS (VALUES " + ", ".join(f"('{n}', '{d}')" for n, d in KNOWN) + """)
SELECT 'name' AS kind, v AS value FROM (SELECT v FROM n UNION SELECT n FROM k) UNION ALL SELECT 'domain', v FROM (SELECT lower(trim(brand_domain)) AS v FROM known_brands UNION SELECT d FROM k)""",
    "lexical_score": f"WITH {M} SELECT * FROM (SELECT email_id, CAST({LEX} AS INT) AS points, {LABELS} AS labels FROM m) WHERE labels <> ''",
    "keyword_position_points": f"WITH {M} SELECT * FROM (SELECT email_id, CAST({POS} AS INT) AS points FROM m) WHERE points > 0",
    "url_extract": f"WITH {EXPLODED} SELECT email_id, pos, url, scheme, host, path, query_str AS query FROM body_urls",
    "url_dedup": f"WITH {M}, {judged('email_urls')} SELECT email_id, pos, url FROM f",
    "url_risk": f"""WITH {M}, {judged('email_urls')} SELECT email_id, pos, score, array_to_string(list_filter([CASE d WHEN 2 THEN 'Unfamiliar domain structure' WHEN 1 THEN 'Domain differs from sender' END,
 CASE WHEN t THEN 'High-risk TLD' END, CASE WHEN s THEN 'URL shortener' END, CASE WHEN c > 0 THEN 'Credential-related terms in URL' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM k""",
    "url_tld_shortener_risk": f"WITH {M}, {judged('email_urls')} SELECT email_id, pos, t AS risky_tld, s AS shortener FROM j",
    "url_credential_score": f"WITH {M}, {judged('email_urls')} SELECT email_id, pos, CAST(c AS INT) AS points FROM j WHERE c > 0",
    "url_domain_risk": f"WITH {M}, {judged('email_urls')} SELECT email_id, pos, CAST(d AS INT) AS points FROM j WHERE d > 0",
    "url_running_cap": f"WITH {M}, {judged('email_urls')} SELECT email_id, pos, score, applied FROM k",
    "host_profile": f"WITH h AS (SELECT host, {strip('host')} AS s FROM email_urls WHERE host <> '') SELECT {reg('s')} AS domain, count(*) AS links, count(DISTINCT host) AS hosts FROM h GROUP BY 1",
    "registrable_domain_topk": f"WITH h AS (SELECT host, {strip('host')} AS s FROM email_urls WHERE host <> '') SELECT {reg('s')} AS domain, count(*) AS links, count(DISTINCT host) AS hosts FROM h GROUP BY 1 ORDER BY links DESC, domain LIMIT 10",
    "attachment_joined_risk": """SELECT * FROM (SELECT email_id, CAST(regexp_matches(lower(attachments), '[.](exe|scr|pif)$') AS INT) AS dangerous, CAST(regexp_matches(lower(attachments), '[.](zip|rar|7z)$') AND length(attachments) > 100 AS INT) AS odd_archives
 FROM parse_eml WHERE attachments <> '') WHERE dangerous + odd_archives > 0""",
    "email_score": f"WITH {SCORED} SELECT email_id, score, label FROM sc",
    "score_label_counts": f"WITH {SCORED} SELECT label, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, max(score) AS highest FROM sc GROUP BY 1",
    "whitelist_floor": f"WITH {SCORED} SELECT email_id, fd AS from_dom, score FROM sc WHERE fd IN {WHITELIST}",
    "explain_summary": f"WITH {SCORED} SELECT email_id, {_by(explain.SEVERITY)} || ': composite score ' || score || '. ' || {_by(explain.GUIDANCE)} AS summary FROM sc",
    "score_percent": f"WITH {SCORED} SELECT email_id, {PERCENT} AS percent FROM sc",
    "summary_report": f"WITH {SCORED} SELECT file AS file_name, CASE WHEN label = 'LOW' THEN 'Legitimate' ELSE 'Phishing' END AS verdict, round({PERCENT}, 2) AS confidence FROM sc ORDER BY 1",
    "body_preview": "SELECT email_id, CASE WHEN length(body) > 500 THEN substr(body, 1, 500) || '...' ELSE body END AS preview FROM parse_eml WHERE body IS NOT NULL",
    "input_signature": "SELECT email_id, sha256(array_to_string(list_sort(list_transform(received, lambda r: r || ':' || length(r))), '|')) AS signature FROM parse_eml WHERE len(received) > 0",
    "document_rollup": "SELECT source, lang, count(*) AS n, CAST(grouping(source, lang) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (source, lang)",
    "digest_dedup": "SELECT sha256(text) AS digest, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "llm_prompt": rf"""WITH x AS (SELECT *, regexp_extract_all(coalesce(body, ''), '{_LINK}') AS l FROM parse_eml),
y AS (SELECT email_id, {_s(_HEAD)} || chr(10) || chr(10) || '**Email Details:**' || chr(10) || '- From: ' || coalesce(from_addr, '') || chr(10) || '- Subject: ' || coalesce(subject, '') || chr(10) || '- Body: ' || coalesce(body, '') || chr(10)
 || '- Attachments: ' || coalesce(attachments, '') || chr(10) || '- URLs found in body: ' || CASE WHEN len(l) > 0 THEN '[''' || array_to_string(l, ''', ''') || ''']' ELSE '[]' END || chr(10) || chr(10) || {_s(_INSTRUCTIONS)} AS p FROM x)
SELECT email_id, CAST(length(p) AS INT) AS chars, sha256(p) AS digest FROM y""",
    "llm_response_parse": """SELECT reply_id, CASE WHEN coalesce(probability, 0) > 50 THEN 'phishing' ELSE 'safe' END AS label, CAST(coalesce(probability, 0) AS DOUBLE) / 100 AS score,
 array_to_string(list_concat(list_transform(coalesce(indicators, []), lambda x: 'Suspicious indicator: ' || x), CASE WHEN reasoning <> '' THEN ['LLM reasoning: ' || reasoning] ELSE [] END), chr(10)) AS told FROM llm_replies""",
    "llm_cache_hit_miss": """WITH r AS (SELECT DISTINCT ON (reply_id) * FROM llm_replies)
SELECT reply_id AS request_id, EXISTS (SELECT 1 FROM r b WHERE b.model = a.model AND b.digest = a.digest AND b.replied_at < a.requested_at AND epoch_us(b.replied_at) >= epoch_us(a.requested_at) - 3600000000) AS hit FROM r a""",
    "tfidf_document_frequency": """WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'))) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM w, n GROUP BY 1 HAVING count(*) >= 2""",
    "class_weights": f"WITH {_TRAIN}, c AS (SELECT CASE WHEN l = 'spam' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, count(*) AS n FROM t GROUP BY 1) SELECT y, n, CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n) AS weight FROM c",
    "classification_report": f"""WITH {_TRAIN}, g AS (SELECT l, CASE WHEN contains(lower(text), 'account') THEN 'spam' ELSE 'ham' END AS p FROM t), x AS (SELECT l AS label FROM g UNION SELECT p FROM g),
c AS (SELECT label, count(*) FILTER (l = label) AS support, count(*) FILTER (p = label) AS given, count(*) FILTER (l = label AND p = label) AS hit FROM x, g GROUP BY 1),
r AS (SELECT label, support, CASE WHEN given > 0 THEN hit / given ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM c)
SELECT label, support, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, (SELECT count(*) FILTER (l = p) / count(*) FROM g) AS accuracy FROM r""",
    "event_window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY 1""",
}

_DEFAULTS = (
    SCORED.replace(FREEMAIL, f"({_q(FREE)})").replace(WHITELIST, f"({_q(urls.WHITELIST)})").replace("SELECT DISTINCT lower(brand_name) AS b FROM known_brands", "SELECT unnest([" + _q(n for n, _ in KNOWN) + "]) AS b")
)
_OWN_ADDRESS = r"""[^\s<>()\[\],;|:"]+@[^\s<>()\[\],;|:"@]+"""
_RANKED = f"{_TRAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY md5(training_id::VARCHAR), training_id) AS k, count(*) OVER (PARTITION BY l) AS n FROM t)"
_MESSAGES = "e AS (SELECT * FROM parse_eml WHERE parse_error IS NULL)"

ORACLES |= {
    "email_score_defaults": f"WITH {_DEFAULTS} SELECT email_id, score, label FROM sc",
    "email_explanations": f"WITH {EXPLAINED} SELECT email_id, score, coalesce(array_to_string(ex, chr(10)), '') AS explanations FROM w1",
    "readable_explanations": READABLE,
    "explain_summary": f"WITH {EXPLAINED} SELECT email_id, {_SUMMARY} AS summary FROM w1",
    "confusable_senders": f"WITH {M}, {KB} SELECT * FROM (SELECT email_id, fh AS host, {conf('fh')} AS reason FROM m) WHERE reason IS NOT NULL",
    "raw_mail_scores": f"WITH {SCORED} SELECT sc.email_id, score, label FROM sc JOIN parse_eml e ON e.email_id = sc.email_id WHERE e.body IS NOT NULL",
    "mime_round_trip": f"""SELECT email_id, coalesce({addr('from_addr')}, 'No Sender') AS from_addr, CASE WHEN trim(subject) <> '' THEN subject ELSE 'No Subject' END AS subject,
 CASE WHEN body = '' THEN '' ELSE body || chr(10) END || 'End of <part>' AS body, translate(coalesce(attachments, ''), '"\\', '__') AS attachments, 'text/plain' AS body_type, CAST(coalesce(len(received), 0) AS INT) AS hops, CAST(NULL AS VARCHAR) AS parse_error FROM parse_eml WHERE body IS NOT NULL""",
    "input_signature": "SELECT email_id, sha256(array_to_string(list_sort([file || ':' || coalesce(length(body), 0), coalesce(attachments, '') || ':' || coalesce(length(attachments), 0)]), '|')) AS signature FROM parse_eml WHERE file IS NOT NULL",
    "digest_dedup": f"""WITH x AS (SELECT sha256('{{' || array_to_string(list_filter([{', '.join(f"CASE WHEN {c} IS NOT NULL THEN {_json(c)} END" for c in ('attachments', 'body', 'from_addr', 'subject'))}], lambda x: x IS NOT NULL), ',') || '}}') AS digest FROM parse_eml)
SELECT digest, count(*) AS copies FROM x GROUP BY 1 HAVING count(*) > 1""",
    "llm_get_or_create": f"""WITH a AS (SELECT DISTINCT email_id, model, digest FROM llm_replies), c AS (SELECT model, digest, epoch_us(replied_at) AS ts, max(probability) AS p FROM llm_replies WHERE replied_at IS NOT NULL GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, digest ORDER BY ts DESC) AS n FROM c WHERE ts <= epoch_us(TIMESTAMP '2024-06-30') AND ts >= epoch_us(TIMESTAMP '2024-06-30') - 180 * 86400000000) WHERE n = 1)
SELECT a.email_id, a.model, a.digest, f.ts IS NOT NULL AS cached, CAST(CASE WHEN f.ts IS NOT NULL THEN f.p ELSE {STUB} END AS INT) AS probability FROM a JOIN parse_eml e ON e.email_id = a.email_id LEFT JOIN f ON f.model = a.model AND f.digest = a.digest""",
    "llm_review_batches": f"""WITH {_MESSAGES}, x AS (SELECT CAST(floor(email_id / 5) AS BIGINT) AS batch_id, email_id, {STUB} AS p FROM e)
SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY email_id) - 1 AS INT) AS pos, CASE WHEN email_id % 3 = 0 THEN '{MODELS[2]}' WHEN email_id % 2 = 0 THEN '{MODELS[0]}' ELSE '{MODELS[1]}' END AS model,
 CASE WHEN p > 50 THEN 'phishing' ELSE 'safe' END AS label, round(p / 100.0::DOUBLE, 4) AS score FROM x""",
    "stratified_split": f"WITH {_RANKED} SELECT training_id, l AS label, k <= floor(n * 0.2::DOUBLE + 0.5) AS is_test FROM r",
    "stratified_split_counts": f"WITH {_RANKED} SELECT l AS label, k <= floor(n * 0.2::DOUBLE + 0.5) AS is_test, count(*) AS n FROM r GROUP BY ALL",
    "downsampled_ham": f"WITH {_RANKED} SELECT l AS label, count(*) AS n, CAST(sum(training_id) AS BIGINT) AS ids FROM r WHERE l <> 'ham' OR k <= 1396 GROUP BY 1",
    "tfidf_document_frequency": r"""WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'))) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM w, n GROUP BY 1 HAVING count(*) >= 2""",
    "url_harvest": f"WITH {M}, {judged('email_urls')} SELECT email_id, pos FROM j WHERE c > 0",
    "zero_width_bodies": f"SELECT email_id FROM parse_eml WHERE regexp_matches(body, '{_ZERO}')",
    "p2_address_items": rf"""WITH x AS (SELECT email_id, 'to_addr' AS field, to_addr AS v FROM parse_eml UNION ALL SELECT email_id, 'cc', cc FROM parse_eml), l AS (SELECT email_id, field, regexp_extract_all(v, '{_OWN_ADDRESS}') AS a FROM x)
SELECT email_id, field, CAST(unnest(range(1, len(a) + 1)) AS INT) AS pos, unnest(a) AS item FROM l""",
    "attachment_risk": r"""WITH x AS (SELECT email_id, lower(attachments) AS a FROM parse_eml), n AS (SELECT email_id, len(regexp_extract_all(a, '\.(exe|scr|pif)["''\]]*\s*([;,|\n\r\t]|$)')) AS d, len(regexp_extract_all(a, '[^;,|\n\r\t"]{97,}\.(zip|rar|7z)["''\]]*\s*([;,|\n\r\t]|$)')) AS o FROM x)
SELECT email_id, CAST(d AS INT) AS dangerous, CAST(o AS INT) AS odd_archives FROM n WHERE d + o > 0""",
    "separate_attachment_points": r"""WITH x AS (SELECT email_id, lower(attachments) AS a FROM parse_eml), n AS (SELECT email_id, 4 * len(regexp_extract_all(a, '\.(exe|scr|pif)["''\]]*\s*([;,|\n\r\t]|$)')) + 2 * len(regexp_extract_all(a, '[^;,|\n\r\t"]{97,}\.(zip|rar|7z)["''\]]*\s*([;,|\n\r\t]|$)')) AS p FROM x)
SELECT email_id, CAST(p AS INT) AS points FROM n WHERE p > 0""",
}

# dates by notation: pattern, and year|month|day|hour|minute|second|fraction|am or pm|zone; F1 and F2 are the slashed parts
_T = r"(\d{1,2})[:.](\d\d)(?:[:.](\d\d)(?:[.,](\d{1,9}))?)?"
_NOTATIONS = [
    (rf"^(\d{{4}})-(\d\d)-(\d\d)[t ]{_T} ?(z|[+-]\d\d:?\d\d)?(?:\[.*\]| [a-z_/]+)?$", r"\1|\2|\3|\4|\5|\6|\7||\8"),
    (rf"^(?:[a-z]+, ?)?(\d{{1,2}})[ -]([^\d\s.-]+)[.]?[ -](\d{{4}}|\d\d) {_T} ?([a-z]{{1,5}}|[+-]\d{{4}})?$", r"\3|\2|\1|\4|\5|\6|\7||\8"),
    (rf"^[a-z]+ ([a-z]+) (\d{{1,2}}) {_T}(?: ([a-z]{{1,5}}))? (\d{{4}})$", r"\8|\1|\2|\3|\4|\5|\6||\7"),
    (r"^(\d{4})(\d\d)(\d\d)t(\d\d)(\d\d)(\d\d)z$", r"\1|\2|\3|\4|\5|\6|||z"),
    (rf"^(\d\d)[.](\d\d)[.](\d{{4}}) {_T}$", r"\3|\2|\1|\4|\5|\6|\7||"),
    (rf"^([a-z]+) (\d{{1,2}}), (\d{{4}}) {_T} ?([ap]m)?$", r"\3|\1|\2|\4|\5|\6|\7|\8|"),
]
_SLASHED = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_T} ?([ap]m)?$"
_CANONICAL = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN regexp_replace(s, '{p}', '{f}')" for p, f in _NOTATIONS)
_CANONICAL += " WHEN regexp_matches(s, '{0}') THEN regexp_replace(s, '{0}', CASE WHEN day_first THEN '{1}' ELSE '{2}' END) END".format(_SLASHED, r"\3|\2|\1|\4|\5|\6|\7|\8|", r"\3|\1|\2|\4|\5|\6|\7|\8|")
_NAMED = "(VALUES " + ", ".join(f"('{n}', {i})" for i, names in enumerate(timestamps.MONTHS, 1) for n in names.split()) + ") AS mn(name, no)"
_ZONED = "(VALUES " + ", ".join(f"('{z}', {m})" for z, m in timestamps.ZONES.items()) + ") AS zn(zone, minutes)"
_local = lambda us: f"epoch_us(timezone(tz, make_timestamptz({us})))"
ORACLES["p6_found"] = rf"""WITH g AS (SELECT gateway, min(tz_name) AS tz, min(day_first) AS day_first FROM gateways GROUP BY 1),
a AS (SELECT email_id, coalesce(tz, 'UTC') AS tz, coalesce(day_first, false) AS day_first, trim(regexp_replace(lower(trim(regexp_replace(date_hdr, '\s+', ' ', 'g'))), ' ?\(.*\)$', '')) AS s FROM parse_eml e LEFT JOIN g ON g.gateway = e.gateway WHERE date_hdr IS NOT NULL),
b AS (SELECT *, string_split({_CANONICAL}, '|') AS p FROM a),
c AS (SELECT b.*, try_cast(p[1] AS INT) AS y, coalesce(try_cast(p[2] AS INT), no) AS mo, try_cast(p[3] AS INT) AS d, try_cast(p[4] AS INT) AS h, p[5] AS mi, CASE WHEN p[6] = '' THEN '00' ELSE p[6] END AS se, CASE WHEN p[7] = '' THEN 0 ELSE CAST(substr(rpad(p[7], 6, '0'), 1, 6) AS INT) END AS us, p[8] AS half, p[9] AS z
 FROM b LEFT JOIN {_NAMED} ON mn.name = p[2] WHERE p IS NOT NULL),
d2 AS (SELECT *, epoch_us(try_cast(printf('%04d-%02d-%02d %02d:%s:%s', CASE WHEN y < 50 THEN y + 2000 WHEN y < 100 THEN y + 1900 ELSE y END, mo, d, CASE WHEN half = '' THEN h ELSE h % 12 + CASE half WHEN 'pm' THEN 12 ELSE 0 END END, mi, se) AS TIMESTAMP)) AS t FROM c WHERE mo IS NOT NULL),
o AS (SELECT *, t - ({_local('t - 86400000000')} - (t - 86400000000)) AS ub, t - ({_local('t + 86400000000')} - (t + 86400000000)) AS ua FROM d2 WHERE t IS NOT NULL),
r AS (SELECT email_id, us + CASE WHEN regexp_matches(z, '^[a-z]') THEN t - CAST(minutes AS BIGINT) * 60000000 WHEN z <> '' THEN t - CAST(CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END * (CAST(substr(z, 2, 2) AS BIGINT) * 60 + CAST(right(z, 2) AS BIGINT)) AS BIGINT) * 60000000
 WHEN {_local('ub')} = t THEN ub WHEN {_local('ua')} = t THEN ua ELSE ub END AS utc_us FROM o LEFT JOIN {_ZONED} ON zone = z),
n AS (SELECT email_id, CASE WHEN regexp_matches(s, '^\d{{10}}$') THEN CAST(s AS BIGINT) * 1000000 WHEN regexp_matches(s, '^\d{{13}}$') THEN CAST(s AS BIGINT) * 1000 WHEN regexp_matches(s, '^\d{{10}}[.]\d{{1,6}}$') THEN CAST(split_part(s, '.', 1) AS BIGINT) * 1000000 + CAST(rpad(split_part(s, '.', 2), 6, '0') AS BIGINT) END AS utc_us FROM a)
SELECT email_id, CAST(utc_us AS BIGINT) AS utc_us FROM (SELECT * FROM r UNION ALL SELECT * FROM n) WHERE utc_us IS NOT NULL"""

# file names: quotes part a value; odd pieces (by number from 0) are literals, the rest ends a name behind an extension
_D = r"[;,|\n\r\t]"
_EXT = r"([.][0-9]*[a-zA-Z][a-zA-Z0-9]*)"
_SINGLE = rf"""(^|{_D} ?|\[)''([^''"\n]*)''(\s*($|[;,|\n\r\t<\]]))"""
_UNDOUBLED = [(r'([^;,|\n\r\t\[ ])""([^;,|\n\r\t ])', r"\1~Q~\2"), (r'([\pL\pN ])""([.])', r"\1~Q~\2"), (r' ""([\pL\pN])', r" ~Q~\1")]
_quoted = "replace(v, '\\\"', '~Q~')"
for _p, _r in _UNDOUBLED:
    _quoted = f"regexp_replace({_quoted}, '{_p}', '{_r}', 'g')"
for _ in range(2):
    _quoted = f"""regexp_replace({_quoted}, '{_SINGLE}', '\\1"\\2"\\3', 'g')"""
_FILES = rf"""fq AS (SELECT email_id, string_split({_quoted}, '"') AS p FROM (SELECT email_id, attachments AS v FROM parse_eml WHERE attachments IS NOT NULL)),
fj AS (SELECT email_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 AND i < len(p) THEN '~O~' || x || CASE WHEN regexp_matches(x, '{_EXT}$') THEN '~B~' ELSE '' END
 ELSE regexp_replace(regexp_replace(x, '{_EXT}\s*(({_D}|/)\s*)+', '\1~B~', 'g'), '^\s*({_D}\s*)+|^\s*\[|\]\s*$', '~B~', 'g') END), '') AS w FROM fq),
fi AS (SELECT email_id, list_filter(list_transform(string_split(w, '~B~'), lambda x: replace(trim(replace(x, '~O~', '')), '~Q~', '"')), lambda x: x <> '') AS a FROM fj)"""
_ITEMS = rf"""x AS (SELECT email_id, 'to_addr' AS field, to_addr AS v FROM parse_eml UNION ALL SELECT email_id, 'cc', cc FROM parse_eml), {_FILES},
l AS (SELECT email_id, field, regexp_extract_all(v, '{_OWN_ADDRESS}') AS a FROM x UNION ALL SELECT email_id, 'attachments', a FROM fi)"""
ORACLES["p2_items"] = f"WITH {_ITEMS} SELECT email_id, field, CAST(unnest(range(1, len(a) + 1)) AS INT) AS pos, unnest(a) AS item FROM l"
ORACLES["p2_found"] = f"WITH {_ITEMS} SELECT email_id, field, CAST(unnest(range(1, len(a) + 1)) AS INT) AS pos, unnest(a) AS item FROM l WHERE len(a) >= 2"


def _html(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_marked = _html("body")
for _p, _, _ in wording.LEXICON:
    _marked = f"""CASE WHEN {_hit(_p)} = '' THEN {_marked} ELSE regexp_replace({_marked}, '(?i)' || {_hit(_p)}, '<mark title="Matched phishing keyword">\\0</mark>', 'g') END"""
ORACLES["highlight_body"] = f"""WITH {EXPLAINED}, h0 AS (SELECT *, list_transform(coalesce(mk, []), lambda x: {_html("x")}) AS hm FROM w1 WHERE len(kw) > 0 OR len(mk) > 0), h1 AS (SELECT *, {_marked} AS hb FROM h0)
SELECT email_id, CASE WHEN len(hm) > 0 THEN list_reduce(hm, lambda a, x: replace(a, split_part(x, chr(1), 1), '<mark title="' || split_part(x, chr(1), 2) || '">' || split_part(x, chr(1), 1) || '</mark>'), hb) ELSE hb END AS marked FROM h1"""

# complement Bayes on TF-IDF of words and pairs of words, fitted on the part that is not test: terms of two or more texts,
# unit length; a class is described by the weights of the other one, smoothed by 1
_TOKENS = r"regexp_extract_all(lower(text), '[\pL\pN_]{2,}')"


def _weights(rows: str) -> str:
    """CTEs: s (words of each text, and whether it is in the test part), x (unit TF-IDF weights), sm (their sums per term and label of the fitted rows)."""
    return f"""{_RANKED}, s0 AS (SELECT training_id, email_id, l, text, k <= floor(n * 0.2::DOUBLE + 0.5) AS is_test, {_TOKENS} AS w FROM r), s AS ({rows}),
tm AS (SELECT training_id, l, is_test, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM s),
tf AS (SELECT training_id, l, is_test, term, count(*) AS c FROM tm GROUP BY ALL), nd AS (SELECT count(*) AS n FROM s WHERE NOT is_test),
df AS (SELECT term, ln(((SELECT n FROM nd) + 1) / (count(*) + 1)) + 1 AS idf FROM tf WHERE NOT is_test GROUP BY 1 HAVING count(*) >= 2),
x AS (SELECT training_id, l, is_test, term, c * idf / sqrt(sum(c * idf * c * idf) OVER (PARTITION BY training_id)) AS v FROM tf JOIN df USING (term)),
sm AS (SELECT term, coalesce(sum(v) FILTER (l = 'ham'), 0) AS h, coalesce(sum(v) FILTER (l = 'spam'), 0) AS p FROM x WHERE NOT is_test GROUP BY 1),
tot AS (SELECT sum(h) AS h, sum(p) AS p, count(*) AS f FROM sm)"""


_COMPLEMENT = f"""{_weights("SELECT * FROM s0")},
th AS (SELECT term, -ln((h + 1) / ((SELECT h + f FROM tot))) AS spam, -ln((p + 1) / ((SELECT p + f FROM tot))) AS ham FROM sm),
lg AS (SELECT s.training_id, s.email_id, s.l, coalesce(sum(v * spam), 0) - coalesce(sum(v * ham), 0) AS lead FROM s LEFT JOIN x ON x.training_id = s.training_id LEFT JOIN th ON th.term = x.term WHERE s.is_test GROUP BY ALL),
pr AS (SELECT training_id, email_id, l, CASE WHEN lead > 0 THEN 'Phishing' ELSE 'Legitimate' END AS verdict, round(100 / (1 + exp(-abs(lead))), 2) AS percent FROM lg)"""
# multinomial Bayes: at most 1,396 ham rows are fitted; a class is described by its own weights, and its share counts
_THINNED = "SELECT * EXCLUDE (hk) FROM (SELECT *, row_number() OVER (PARTITION BY is_test, l ORDER BY md5(text), text) AS hk FROM s0) WHERE is_test OR l <> 'ham' OR hk <= 1396"
_MULTINOMIAL = f"""{_weights(_THINNED)},
th AS (SELECT term, ln((p + 1) / ((SELECT p + f FROM tot))) AS spam, ln((h + 1) / ((SELECT h + f FROM tot))) AS ham FROM sm), cl AS (SELECT ln(count(*) FILTER (l = 'spam') / count(*) FILTER (l = 'ham')) AS prior FROM s WHERE NOT is_test),
lg AS (SELECT s.training_id, coalesce(sum(v * spam), 0) - coalesce(sum(v * ham), 0) + (SELECT prior FROM cl) AS lead FROM s LEFT JOIN x ON x.training_id = s.training_id LEFT JOIN th ON th.term = x.term WHERE s.is_test GROUP BY ALL),
pr AS (SELECT training_id, CASE WHEN lead > 0 THEN 'Phishing' ELSE 'Legitimate' END AS verdict, round(100 / (1 + exp(-abs(lead))), 2) AS percent FROM lg)"""
_REPORT = """x AS (SELECT l AS label FROM g UNION SELECT p FROM g), c AS (SELECT label, count(*) FILTER (l = label) AS support, count(*) FILTER (p = label) AS given, count(*) FILTER (l = label AND p = label) AS hit FROM x, g GROUP BY 1),
r AS (SELECT label, support, CASE WHEN given > 0 THEN hit / given ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM c)
SELECT label, support, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, (SELECT count(*) FILTER (l = p) / count(*) FROM g) AS accuracy FROM r"""
ORACLES |= {
    "train_predict_nb_complement": f"WITH {_COMPLEMENT} SELECT training_id, verdict, percent, printf('%.2f', percent) AS shown FROM pr",
    "train_predict_nb_multinomial": f"WITH {_MULTINOMIAL} SELECT training_id, verdict, percent, printf('%.2f', percent) AS shown FROM pr",
    "model_report": f"WITH q AS (WITH {_COMPLEMENT} SELECT * FROM pr), g AS (SELECT l, CASE verdict WHEN 'Phishing' THEN 'spam' ELSE 'ham' END AS p FROM q), {_REPORT}",
    "ml_with_rules": f"""WITH q AS (WITH {_COMPLEMENT} SELECT * FROM pr), rules AS (WITH {SCORED} SELECT email_id, label, score FROM sc)
SELECT q.email_id, verdict, label AS rules_label, score AS rules_score, (verdict = 'Phishing') = (label <> 'LOW') AS agree FROM q LEFT JOIN rules ON rules.email_id = q.email_id""",
}
