"""What the later operators' queries give, as SQL for DuckDB: numbers written out by loops, logic as plain joins and lists."""

from __future__ import annotations

from strandline.llm import pii

#: CRC-32 of a string of ASCII characters, bit by bit: each byte, then eight shifts.
CRC32 = "xor(list_reduce([4294967295::BIGINT] || flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split({0}, '')]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a // 2, 3988292384 * (a % 2)) END), 4294967295)"


def merkle(levels: int = 8) -> str:
    """Trees of up to 8 ** levels leaves a group, and as many groups."""
    field = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: f"sha256(concat({field('doc_id')}, {field('source')}, {field('lang')}, {field('n_chars')}, {field(text)}))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"l AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS h, CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(low)} END AS t FROM documents)",
        "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM l)",
        "t0 AS (SELECT coalesce('x' || lang, '') AS g, i, h FROM a0)",
    ]

    def tree(name: str, out: str) -> None:
        for k in range(levels):
            steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY g, i // 8)")
            # what stands before and after each node in its run; nothing where the tree has ended
            steps.append(f"{name}p{k} AS MATERIALIZED (SELECT g, i, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a, count(*) OVER (PARTITION BY g) > 1 AS more FROM {name}{k})")
        steps.append(f"{out} AS (SELECT g, h FROM {name}{levels})")

    tree("t", "subroots")
    steps.append("u0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM subroots)")
    steps.append("named AS (SELECT g AS of, row_number() OVER (ORDER BY g) - 1 AS j, h AS subroot FROM subroots)")
    tree("u", "roots")
    steps.append("f0 AS (SELECT doc_id, a0.h AS leaf, coalesce('x' || lang, '') AS g, i, j, subroot, roots.h AS root, coalesce(t, a0.h) AS c, '' AS proof FROM a0 JOIN named ON of = coalesce('x' || lang, '') CROSS JOIN roots)")
    n = 0
    for name, on, at in (("t", "p.g = f.g", "i"), ("u", "true", "j")):
        for k in range(levels):
            steps.append(f"f{n + 1} AS MATERIALIZED (SELECT f.* REPLACE (CASE WHEN more THEN sha256(b || c || a) ELSE c END AS c, CASE WHEN more THEN proof || b || a ELSE proof END AS proof) FROM f{n} f JOIN {name}p{k} p ON {on} AND p.i = f.{at} // {8**k})")
            n += 1
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, c AS folded_root, c = root AS verified FROM f{n}"


def codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    steps = [
        f"""good AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"w AS (SELECT ceil(max(len(v)) / {parts}::DOUBLE)::BIGINT AS w FROM good)",
        f"x AS MATERIALIZED (SELECT r, p, [coalesce(v[k], 0) FOR k IN range(p * w + 1, (p + 1) * w + 1)] AS v FROM good, w, range({parts}) AS t(p))",
        f"c0 AS MATERIALIZED (SELECT p, e, x.v FROM (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM good) JOIN x USING (r) WHERE e < {entries})",
    ]
    near = lambda k: f"SELECT r, x.p, min({{'d': list_sum([(x.v[k] - c.v[k]) * (x.v[k] - c.v[k]) FOR k IN range(1, len(x.v) + 1)])::BIGINT, 'e': e}}) AS b FROM x JOIN c{k} c USING (p) GROUP BY r, x.p"
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near(k)})")
        steps.append(f"s{k} AS (SELECT p, b.e AS e, k, floor(sum(v[k])::DOUBLE / count(*))::BIGINT AS m FROM a{k} JOIN x USING (r, p), unnest(range(1, len(v) + 1)) AS t(k) GROUP BY p, b.e, k)")
        steps.append(f"m{k} AS (SELECT p, e, list(m ORDER BY k) AS v FROM s{k} GROUP BY p, e)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (p, e))")
    steps.append(f"z AS MATERIALIZED ({near(rounds)})")
    steps.append("coded AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM z GROUP BY r)")
    steps.append(f"book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS s FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256 FROM good JOIN coded USING (r), book"


def private() -> str:
    """Base patterns as they are given; proposals stand alone if the characters around them say so."""
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits, luhn = "regexp_replace({0}, '[^0-9]', '', 'g')", "list_sum([CASE WHEN (len({0}) - i) % 2 = 0 THEN {0}[i]::INT WHEN {0}[i]::INT > 4 THEN 2 * {0}[i]::INT - 9 ELSE 2 * {0}[i]::INT END FOR i IN range(1, len({0}) + 1)]) % 10 = 0"
    card = f"len({digits.format('m')}) BETWEEN 13 AND 19 AND {luhn.format(digits.format('m'))}"
    holds = {"email": "true", "ip": "len([x FOR x IN string_split(m, '.') IF len(ltrim(x, '0')) > 3 OR (len(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255')]) = 0", "card": card, "phone": f"len({digits.format('m')}) BETWEEN 9 AND 15"}
    bare = "replace(m, ' ', '')"
    moved = f"({bare}[5:] || {bare}[1:4])"
    mod97 = f"list_reduce([0::BIGINT] || [CASE WHEN c >= 'A' THEN 1000 + ascii(c) - 55 ELSE ascii(c) - 48 END::BIGINT FOR c IN string_split({moved}, '')], lambda a, x: CASE WHEN x >= 1000 THEN a * 100 + x - 1000 ELSE a * 10 + x END % 97) = 1"

    def found(name: str, source: str, pattern: str) -> str:
        """n, off (where the text begins), before and after the text -> its matches."""
        return f"""{name} AS MATERIALIZED (SELECT n, off + start AS start, off + start + len(m) AS stop, m, (CASE WHEN start < {pii.CONTEXT} THEN before ELSE '' END) || b[-{pii.CONTEXT}:] AS b, a[:{pii.CONTEXT}] || (CASE WHEN start + len(m) + {pii.CONTEXT} > len(t) THEN after ELSE '' END) AS a, (b = '' AND i > 1) OR (a = '' AND i < size) AS touched FROM
  (SELECT n, off, t, before, after, i, len(ms) AS size, ms[i] AS m, gs[i] AS b, gs[i + 1] AS a, list_sum([len(x) FOR x IN gs[1:i]])::BIGINT + coalesce(list_sum([len(x) FOR x IN ms[1:i - 1]]), 0)::BIGINT AS start
    FROM (SELECT *, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM {source}), unnest(range(1, len(ms) + 1)) AS u(i)))"""

    def good(kind: str, checked: bool = True) -> str:
        r = pii.RULES[kind]
        says = lambda words: rf"regexp_matches(lower(b || ' | ' || a), '(?:^|[^a-z])(?:{words})(?:$|[^a-z])')"
        points = f"{r.prior + r.checked} + CASE WHEN {says(r.near)} THEN {r.near_worth} ELSE 0 END - CASE WHEN {says(r.against)} THEN {r.against_worth} ELSE 0 END"
        return f"NOT touched AND NOT regexp_matches(b[-1:], '[A-Za-z0-9+]') AND NOT regexp_matches(a[:1], '[A-Za-z0-9]') AND {points} >= {pii.KEPT}"

    steps = ["d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t, 0::BIGINT AS off, '' AS before, '' AS after FROM documents)"]
    for k, p in base.items():
        steps.append(found(f"b_{k}", "d", p))
    steps.append(f"runs AS (SELECT n, start AS off, m AS t, b AS before, a AS after FROM b_card WHERE len(m) >= 16 AND NOT ({card}))")
    gaps = f"unnest(regexp_split_to_array(t, '{base['phone']}')) AS t, unnest(range(0, len(regexp_split_to_array(t, '{base['phone']}')))) AS i"
    steps.append(f"gaps AS (SELECT n, CASE WHEN i = 0 THEN 0 ELSE ends[i] END AS off, t, CASE WHEN i = 0 THEN '' ELSE '+' END AS before, '' AS after FROM (SELECT n, {gaps} FROM d) LEFT JOIN (SELECT n, list(stop ORDER BY start) AS ends FROM b_phone GROUP BY n) USING (n))")
    steps.append(found("m_card", "runs", r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}"))
    steps.append(found("m_phone", "gaps", pii.PHONE_GROUPS))
    steps.append(found("m_iban", "d", pii.IBAN))
    every = [f"SELECT n, '{k}' AS kind, {i} AS o, start, stop, true AS base FROM b_{k} WHERE {holds[k]}" for i, k in enumerate(base)]
    every += [f"SELECT n, 'card', 2, start, stop, false FROM m_card WHERE {card} AND {good('card')}", f"SELECT n, 'phone', 3, start, stop, false FROM m_phone WHERE {good('phone')}", f"SELECT n, 'iban', 4, start, stop, false FROM m_iban WHERE len({bare}) BETWEEN 15 AND 34 AND {mod97} AND {good('iban')}"]
    steps.append("s AS (" + "\n  UNION ALL ".join(every) + ")")
    counts = ", ".join(f"count(s.n) FILTER (base AND kind = '{k}') AS n_{k}" for k in base)
    text = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start){0}, '')"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, {counts}, sha256({text.format(' FILTER (base)')}) AS base_sha256, {text.format('')} AS spans FROM d LEFT JOIN s USING (n) GROUP BY n, doc_id"
