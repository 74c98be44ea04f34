"""Reusable DuckDB SQL fragments for the oracle queries.

These are independent restatements of each operator's rule in SQL (the check
compares them with the Spark plans); they are not used by the Spark side.
"""

from __future__ import annotations

# Unicode White_Space class, same as parasift.functions.text.WS.
WS = r"[\p{Z}\s\x0B\x{85}]"


WS_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WS_SQL = " || ".join(f"chr({c})" for c in WS_CODEPOINTS)


def utrim(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


def unit(v: str) -> str:
    """L2-normalised list; zero vector unchanged."""
    return (
        f"CASE WHEN list_dot_product({v}, {v}) = 0 THEN {v} "
        f"ELSE list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v}))) END"
    )


def cosine(a: str, b: str) -> str:
    return (
        f"CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0 "
        f"ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"
    )


def centroid_cte(name: str, src: str, key: str, vec: str) -> str:
    """``name(key, cv)``: component mean per group."""
    return f"""
{name}_x AS (SELECT {key}, unnest({vec}) AS x, generate_subscripts({vec}, 1) AS i FROM {src}),
{name} AS (SELECT {key}, list(m ORDER BY i) AS cv
           FROM (SELECT {key}, i, avg(x) AS m FROM {name}_x GROUP BY {key}, i) GROUP BY {key})"""


def mmr_cte(name: str, base: str, key: str, pos: str, k: int | str, lam: float) -> str:
    """Recursive MMR over ``base(key, pos, u, rep, n)``.

    Output ``name(key, rank, pos, rep, mmr_score, picked, us, n)``, one row per pick.
    """
    lam_s = repr(float(lam))
    return f"""
{name} AS (
  SELECT {key}, 1 AS rank, {pos}, rep, rep AS mmr_score, [{pos}] AS picked, [u] AS us, n
  FROM {base}
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(rep, 9) DESC, {pos} DESC) = 1
  UNION ALL
  SELECT {key}, rank, {pos}, rep, sc AS mmr_score, picked, us, n FROM (
    SELECT m.{key}, m.rank + 1 AS rank, b.{pos}, b.rep,
      CAST({lam_s} AS DOUBLE) * b.rep - CAST(1.0 - {lam_s} AS DOUBLE)
        * greatest(0.0, list_max(list_transform(m.us, lambda w: list_dot_product(b.u, w)))) AS sc,
      list_append(m.picked, b.{pos}) AS picked, list_append(m.us, b.u) AS us, m.n
    FROM {name} m JOIN {base} b ON b.{key} = m.{key}
    WHERE m.rank < least({k}, m.n) AND NOT list_contains(m.picked, b.{pos})
    QUALIFY row_number() OVER (PARTITION BY m.{key} ORDER BY round(sc, 9) DESC, b.{pos} ASC) = 1
  )
)"""


def vec_base(k_label: str = "label") -> str:
    """Embeddings grouped by label: e(vec_id,label,v), c(label,cv), b(label,vec_id,u,rep,n)."""
    return f"""
e AS (SELECT vec_id, {k_label}, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{centroid_cte('c', 'e', k_label, 'v')},
b AS (
  SELECT e.{k_label}, e.vec_id, {unit('v')} AS u, {cosine('v', 'cv')} AS rep,
         count(*) OVER (PARTITION BY e.{k_label}) AS n
  FROM e JOIN c USING ({k_label})
)"""


def pair_avg(picks: str, key: str, pos: str, uvec: str = "u") -> str:
    """Mean dot product over unordered pairs of picks (unit vectors), 0 if < 2."""
    return f"""
SELECT p.{key}, avg(list_dot_product(p.{uvec}, q.{uvec})) AS apc
FROM {picks} p JOIN {picks} q ON p.{key} = q.{key} AND p.{pos} < q.{pos}
GROUP BY p.{key}"""


def segments_cte(name: str, src: str, key: str, text: str) -> str:
    """``name(key, position, path, segment_id, text)``: trimmed non-blank lines."""
    return f"""
{name}_l AS (
  SELECT {key}, ln, {utrim('line')} AS text
  FROM (SELECT {key}, unnest(string_split(coalesce({text}, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce({text}, ''), chr(10)), 1) AS ln FROM {src})
),
{name} AS (
  SELECT {key}, position, 'p[' || CAST(position AS VARCHAR) || ']' AS path, sha256(text) AS segment_id, text
  FROM (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY ln) - 1 AS BIGINT) AS position, text
        FROM {name}_l WHERE text <> '')
)"""


def hash_embed_cte(name: str, src: str, dim: int) -> str:
    """``name(segment_id, v)``: signed feature-hashing embedding of ``src(segment_id, text)``,
    L2-normalised and rounded to float32."""
    return f"""
{name}_t AS (SELECT segment_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {src}),
{name}_b AS (
  SELECT segment_id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {dim} AS b,
         CASE WHEN substr(md5(t), 9, 1) < '8' THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS s
  FROM {name}_t WHERE t <> ''
),
{name}_w AS (SELECT segment_id, b, sum(s) AS w FROM {name}_b GROUP BY segment_id, b),
{name}_n AS (SELECT segment_id, sqrt(sum(w * w)) AS nrm, map_from_entries(list({{'k': b, 'v': w}})) AS m
             FROM {name}_w GROUP BY segment_id),
{name} AS (
  SELECT s.segment_id,
         CASE WHEN n.nrm IS NULL OR n.nrm = 0 THEN list_transform(range({dim}), lambda i: CAST(0 AS DOUBLE))
              ELSE list_transform(range({dim}), lambda i: CAST(CAST(coalesce(n.m[i], 0) / n.nrm AS FLOAT) AS DOUBLE)) END AS v
  FROM {src} s LEFT JOIN {name}_n n USING (segment_id)
)"""


def decode_entities(x: str) -> str:
    """Single-pass decoding of the character references that occur in pages
    (``&amp;`` last, so ``&amp;lt;`` stays ``&lt;``)."""
    out = x
    for ent, rep in [("&quot;", "'\"'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&nbsp;", "chr(160)"),
                     ("&#39;", "''''"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)")]:
        out = f"replace({out}, '{ent}', {rep})"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


def reescape(x: str) -> str:
    """Serialisation escaping of text inside an element's inner HTML."""
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), chr(160), '&nbsp;'), '<', '&lt;'), '>', '&gt;')"


def node_text(x: str) -> str:
    """Text nodes of an HTML fragment joined by one space, entities decoded."""
    marked = f"regexp_replace({x}, '(?:<[^>]*>)+', chr(1), 'g')"
    return decode_entities(f"replace(trim({marked}, chr(1)), chr(1), ' ')")


P_BLOCKS = (
    "address|article|aside|blockquote|center|details|dialog|dir|div|dl|fieldset|figcaption|figure|footer|"
    "header|hgroup|main|menu|nav|ol|section|summary|ul|h[1-6]|pre|form|table|li|dd|dt|body|html"
)


def pages_ctes() -> str:
    """pg(page_id, url, html, body): scripts, styles and comments removed;
    pn(page_id, b): every paragraph explicitly closed."""
    return rf"""
pg AS (
  SELECT page_id, url, html,
         regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS body
  FROM pages
),
pn AS (
  SELECT page_id,
         regexp_replace(regexp_replace(body, '<p([\s>])', '</p><p\1', 'gi'),
                        '(</?(?:{P_BLOCKS})[\s>/]|<hr[\s>/])', '</p>\1', 'gi') AS b
  FROM pg
)"""


def title_sql() -> str:
    """tt(page_id, url, title): the title cascade."""
    def blank(e):
        return f"({utrim(f'coalesce({e}, {chr(39)}{chr(39)})')} = '')"
    t1 = f"CASE WHEN regexp_matches(html, '(?i)<title') THEN {reescape(decode_entities(regexp_title()))} END"
    t2 = (f"CASE WHEN regexp_matches(body, '(?i)<h1[^>]*class=\"(?:[^\"]*\\s)?firstHeading(?:\\s[^\"]*)?\"') THEN "
          + reescape(decode_entities("regexp_extract(body, '(?is)<h1[^>]*class=\"(?:[^\"]*\\s)?firstHeading(?:\\s[^\"]*)?\"[^>]*>(.*?)</h[1-6]>', 1)"))
          + " END")
    t3 = (f"CASE WHEN regexp_matches(body, '(?i)<h1[\\s>]') THEN "
          + reescape(decode_entities("regexp_extract(body, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h[1-6]>', 1)")) + " END")
    return f"""
tc AS (SELECT page_id, url, {t1} AS t1, {t2} AS t2, {t3} AS t3 FROM pg),
tt AS (
  SELECT page_id, url,
         CASE WHEN NOT {blank('t1')} THEN t1 WHEN NOT {blank('t2')} THEN t2 WHEN NOT {blank('t3')} THEN t3 END AS title
  FROM tc
)"""


def regexp_title() -> str:
    return "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


def paragraphs_sql() -> str:
    """mp(page_id, para_pos, sel, text): winning paragraphs of the selector cascade."""
    regions = [
        (0, r"(?is)<div[^>]*\sid=\"mw-content-text\"[^>]*>(.*?)</div>"),
        (1, r"(?is)<div[^>]*\sclass=\"(?:[^\"]*\s)?mw-parser-output(?:\s[^\"]*)?\"[^>]*>(.*?)</div>"),
        (2, r"(?is)<div[^>]*\sclass=\"(?:[^\"]*\s)?content(?:\s[^\"]*)?\"[^>]*>(.*?)</div>"),
        (3, r"(?is)<article(?:\s[^>]*)?>(.*?)</article>"),
        (4, r"(?is)<main(?:\s[^>]*)?>(.*?)</main>"),
    ]
    parts = [
        f"SELECT page_id, {sel} AS sel, unnest(regexp_extract_all(b, '{rx}', 1)) AS r, "
        f"generate_subscripts(regexp_extract_all(b, '{rx}', 1), 1) AS ri FROM pn"
        for sel, rx in regions
    ]
    parts.append("SELECT page_id, 5 AS sel, b AS r, 1 AS ri FROM pn")
    union = "\n  UNION ALL ".join(parts)
    prx = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
    return f"""
rg AS (
  {union}
),
px AS (
  SELECT page_id, sel, ri, unnest(regexp_extract_all(r, '{prx}', 1)) AS inner_html,
         generate_subscripts(regexp_extract_all(r, '{prx}', 1), 1) AS pi
  FROM rg
),
pq AS (
  SELECT page_id, sel, ri, pi, {node_text('inner_html')} AS text FROM px
),
pk AS (SELECT * FROM pq WHERE strlen({utrim('text')}) > 10),
win AS (SELECT page_id, min(sel) AS sel FROM pk GROUP BY page_id),
mp AS (
  SELECT pk.page_id, CAST(row_number() OVER (PARTITION BY pk.page_id ORDER BY ri, pi) - 1 AS BIGINT) AS para_pos,
         pk.sel, pk.text
  FROM pk JOIN win USING (page_id, sel)
),
tcx AS (
  SELECT p.page_id, coalesce(string_agg(mp.text, chr(10) || chr(10) ORDER BY mp.para_pos), '') AS text_content
  FROM pages p LEFT JOIN mp USING (page_id) GROUP BY p.page_id
)"""


def links_sql() -> str:
    """lk(page_id, link_pos, url, text): kept links in document order."""
    arx = r"(?is)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    return f"""
la AS (
  SELECT page_id, unnest(regexp_extract_all(body, '{arx}', 1)) AS href_raw,
         unnest(regexp_extract_all(body, '{arx}', 2)) AS inner_html,
         generate_subscripts(regexp_extract_all(body, '{arx}', 1), 1) AS ai
  FROM pg
),
lb AS (SELECT page_id, ai, {decode_entities('href_raw')} AS url, {reescape(node_text('inner_html'))} AS text FROM la),
lk AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ai) - 1 AS BIGINT) AS link_pos, url, text
  FROM lb
  WHERE {utrim('url')} <> '' AND NOT starts_with(url, '#')
    AND NOT ({utrim('text')} = '' AND NOT starts_with(url, 'http'))
)"""


def headings_sql() -> str:
    """hd(page_id, heading_pos, level, heading)."""
    hrx = r"(?is)<h([1-3])(?:\s[^>]*)?>(.*?)</h[1-6]>"
    return f"""
ha AS (
  SELECT page_id, unnest(regexp_extract_all(body, '{hrx}', 1)) AS lvl,
         unnest(regexp_extract_all(body, '{hrx}', 2)) AS inner_html,
         generate_subscripts(regexp_extract_all(body, '{hrx}', 1), 1) AS hi
  FROM pg
),
hb AS (SELECT page_id, CAST(lvl AS INTEGER) AS level, hi, {reescape(node_text('inner_html'))} AS heading FROM ha),
hd AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY level, hi) - 1 AS BIGINT) AS heading_pos,
         level, heading
  FROM hb WHERE {utrim('heading')} <> ''
)"""


def clean_text(x: str) -> str:
    out = x
    for src, dst in [("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"),
                     ("&quot;", "'\"'"), ("&#39;", "''''")]:
        out = f"replace({out}, '{src}', {dst})"
    return utrim(f"regexp_replace({out}, '{WS}+', ' ', 'g')")


def format_link(url: str, text: str, markdown: bool) -> str:
    cu, ct = clean_text(url), clean_text(text)
    same = f"({ct} = '' OR {ct} = {cu})"
    if markdown:
        return f"'[' || CASE WHEN {same} THEN {cu} ELSE {ct} END || '](' || {cu} || ')'"
    return f"CASE WHEN {same} THEN {cu} ELSE {ct} || ' -> ' || {cu} END"
