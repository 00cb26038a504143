"""DuckDB SQL for the queries that SQL can express, written without their joins and filters."""

from __future__ import annotations

# The rules, phrases and notices again, in SQL's own words, so that a slip in the operators shows.
RULES = {
    "symbols": "n_symbols::DOUBLE / nullif(n_words, 0) / 0.1::DOUBLE",
    "dup_lines": "n_dup_lines::DOUBLE / nullif(n_lines, 0) / 0.3::DOUBLE",
    "repeats": "n_repeat_words::DOUBLE / nullif(n_words, 0) / 0.18::DOUBLE",
    "capitals": "n_capitals::DOUBLE / nullif(word_chars, 0) / 0.3::DOUBLE",
    "word_length": "word_chars::DOUBLE / nullif(n_words, 0) / 10",
    "marks": "n_marks::DOUBLE / nullif(n_words, 0) / 0.1::DOUBLE",
}
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
NOTICES = """
    ('agpl-notice', 'you can redistribute it and or modify it under the terms of the gnu affero general public license'),
    ('apache-2.0', 'licensed under the apache license version 2 0'),
    ('artistic-2.0', 'you can redistribute it under the terms of the artistic license 2 0'),
    ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted'),
    ('bsd-endorsement', 'neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software'),
    ('bsl-1.0', 'distributed under the boost software license version 1 0'),
    ('cc-by-4.0', 'licensed under a creative commons attribution 4 0 international license'),
    ('cc-by-nc-4.0', 'licensed under cc by nc 4 0'),
    ('cc-by-nc-sa-4.0', 'licensed under cc by nc sa 4 0'),
    ('cc-by-nd-4.0', 'licensed under cc by nd 4 0'),
    ('cc-by-sa-4.0', 'licensed under cc by sa 4 0'),
    ('cc0-1.0', 'to the extent possible under law the author has waived all copyright and related or neighboring rights to this work'),
    ('epl-2.0', 'this program and the accompanying materials are made available under the terms of the eclipse public license 2 0'),
    ('gfdl', 'permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license'),
    ('gpl-3.0', 'this work is licensed under the gnu general public license version 3'),
    ('gpl-notice', 'you can redistribute it and or modify it under the terms of the gnu general public license'),
    ('isc', 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted'),
    ('lgpl-notice', 'you can redistribute it and or modify it under the terms of the gnu lesser general public license'),
    ('mit', 'released under the mit license'),
    ('mit-grant', 'permission is hereby granted free of charge to any person obtaining a copy of this software'),
    ('mit-warranty', 'the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability'),
    ('mpl-2.0', 'this source code form is subject to the terms of the mozilla public license v 2 0'),
    ('odbl', 'this database is made available under the open database license'),
    ('ofl-1.1', 'this font software is licensed under the sil open font license version 1 1'),
    ('unlicense', 'this is free and unencumbered software released into the public domain'),
    ('zlib', 'this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software')"""
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"[^\x20\x09-\x0D]"


def license_scan(threshold: float = 0.9, block: int = 64) -> str:
    places = []
    for words in PHRASES.values():
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        places.append(f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: {test})")
    labels = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for p, label in zip(places, PHRASES, strict=True))
    return rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
        b AS (SELECT doc_id, w, len(w) AS n_words, list_concat(list_concat({places[0]}, {places[1]}), {places[2]}) AS spots,
              list_sort(list_filter([{labels}], lambda x: x IS NOT NULL)) AS base FROM d),
        t AS (SELECT label, list_distinct(string_split(notice, ' ')) AS tokens FROM (VALUES {NOTICES}) n(label, notice)),
        blocks AS (SELECT doc_id, list_distinct(w[s + 1:s + {block}]) AS words
                   FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 1 - {block // 2}, 0) + 1, {block // 2})) AS s FROM d)),
        hits AS (SELECT doc_id, label, max(len(list_intersect(tokens, words)) / len(tokens)) AS c FROM blocks, t
                 WHERE len(list_intersect(tokens, words)) >= ceil({threshold} * len(tokens) - 1e-9) GROUP BY 1, 2),
        found AS (SELECT doc_id, list(label) AS labels, max(c) AS best FROM hits GROUP BY 1)
        SELECT doc_id, n_words::BIGINT AS n_words, len(spots)::BIGINT AS n_base, list_min(spots) - 1 AS first_word, list_max(spots) - 1 AS last_word,
               array_to_string(base, ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
               CASE WHEN len(spots) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
        FROM b LEFT JOIN found USING (doc_id)"""


def quality_rules(most: float = 0.02, risk: float = 0.05, price: float = 20.0) -> str:
    levels = ", ".join(f"coalesce(least(20000, floor(({value}) * 100))::INT, 0) AS {rule}" for rule, value in RULES.items())
    fails = ", ".join(f"coalesce({r} > cutoff, false) AS {r}_failed" for r in RULES)
    return rf"""
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{BLANK}+') AS words,
              list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{BLANK}')) AS lines FROM documents),
        tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
        rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
        cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS spot FROM rep, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY 1),
        f AS (SELECT w.doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
              len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
              coalesce(n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(text, '[!?]')) AS n_marks
              FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
        j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {levels} FROM f),
        holdout AS (SELECT stratum, good, greatest({", ".join(RULES)}) AS score FROM j JOIN (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1) l ON l.doc_id = j.doc_id WHERE NOT base_failed),
        sizes AS (SELECT *, row_number() OVER (ORDER BY n DESC, stratum) AS m FROM (SELECT stratum, count(*) FILTER (good) AS n FROM holdout GROUP BY 1)),
        strata AS (SELECT stratum, n, CASE WHEN n * ln(1 - {most}) <= ln({risk} / (m + 1)) THEN 'alone ' || stratum ELSE 'rest' END AS unit FROM sizes),
        units AS (SELECT unit, sum(n)::BIGINT AS n FROM strata GROUP BY 1),
        terms AS (SELECT unit, n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({most}) + (n - i) * ln(1 - {most})) AS p
                  FROM (SELECT unit, n, unnest(range(0, floor(n * {most})::BIGINT + 1)) AS i FROM units)),
        tails AS (SELECT unit, i, sum(p) OVER (PARTITION BY unit ORDER BY i) AS tail FROM terms),
        allowed AS (SELECT unit, coalesce(max(i) FILTER (tail <= {risk} / (SELECT count(*) FILTER (unit <> 'rest') + 1 FROM strata)), -1) AS k FROM tails GROUP BY 1),
        counts AS (SELECT unit, score, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM holdout JOIN strata USING (stratum) GROUP BY 1, 2),
        above AS (SELECT unit, score - 1 AS cutoff, sum(good) OVER v AS good, sum(bad) OVER v AS bad FROM counts WINDOW v AS (PARTITION BY unit ORDER BY score DESC)),
        gains AS (SELECT unit, cutoff, bad - {price} * good AS gain FROM above JOIN allowed USING (unit) WHERE good <= k AND bad - {price} * good > 0),
        cuts AS (SELECT stratum, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY gain DESC, cutoff DESC) AS gains_n FROM gains) JOIN strata s USING (unit) WHERE gains_n = 1)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(greatest({", ".join(RULES)}) > cutoff, false) AS kept, j.stratum, {fails}
        FROM j LEFT JOIN cuts ON cuts.stratum = j.stratum"""


URL_FILTER = r"""
    WITH p AS (SELECT page_id, url, 1704067200 + (page_id * 1000003) % 31536000 AS fetched,
               nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
               coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages),
    s AS (SELECT page_id, host, string_split(host, '.') AS ls, string_split(path, '/') AS ps FROM p WHERE host IS NOT NULL),
    k AS (SELECT page_id, 'host' AS kind, host AS pattern FROM s
          UNION ALL SELECT page_id, 'domain', array_to_string(ls[i:len(ls)], '.') FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM s)
          UNION ALL SELECT page_id, 'path', host || array_to_string(ps[1:i], '/') || '/' FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM s)),
    e AS (SELECT kind, pattern, code FROM (SELECT DISTINCT kind, pattern, ('0x' || substr(md5(kind || ' ' || pattern), 1, 7))::BIGINT AS code FROM k) WHERE code % 4 = 0),
    v AS (SELECT kind, pattern, 'block' AS verdict, 1704067200 + (code % 97) * 86400 AS a, 1704067200 + (100 + code % 89) * 86400 AS b FROM e
          UNION ALL SELECT kind, pattern, CASE WHEN code % 3 = 0 THEN 'allow' ELSE 'block' END, 1704067200 + (200 + code % 101) * 86400, NULL FROM e),
    m AS (SELECT page_id, kind, pattern, verdict, CASE kind WHEN 'path' THEN 3 WHEN 'host' THEN 2 ELSE 1 END AS r FROM k JOIN p USING (page_id) JOIN v USING (kind, pattern)
          WHERE fetched >= a AND (b IS NULL OR fetched < b)),
    g AS (SELECT page_id, count(*) AS n, string_agg(kind || ':' || pattern || '=' || verdict, ',' ORDER BY kind || ':' || pattern || '=' || verdict) AS matched,
          arg_max(verdict, (r, length(pattern), pattern)) AS verdict FROM m GROUP BY 1)
    SELECT p.page_id AS capture_id, url, fetched AS fetched_s, coalesce(n, 0) AS n_active, coalesce(matched, '') AS matched, coalesce(verdict, 'allow') = 'allow' AS kept
    FROM p LEFT JOIN g USING (page_id)"""


def merkle_manifest(deep: int = 7, wide: int = 3) -> str:
    """Trees of up to 8 ** deep leaves a language, and of 8 ** wide languages, by self-joins of each level."""
    sealed = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(sealed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: list_concat([ascii((doc_id::VARCHAR)[i])::BIGINT], list_resize([]::BIGINT[], 8, -1))))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, x: {step}), 4294967295)"

    def tree(p: str, base: str, levels: int) -> list[str]:
        out = [f"{p}0 AS ({base})"]
        for k in range(1, levels + 1):
            up = f"{p}{k - 1}"
            out.append(f"{p}{k} AS (SELECT g, rank // 8 AS rank, ceil(n / 8)::BIGINT AS n, sha256(string_agg(digest, '' ORDER BY rank)) AS digest FROM {up} WHERE n > 1 GROUP BY ALL)")
        for k in range(levels):
            side = lambda test: f"coalesce(string_agg(o.digest, '' ORDER BY o.rank) FILTER (o.rank {test} m.rank), '')"
            out.append(
                f"{p}s{k} AS (SELECT m.g, m.rank, {side('<')} AS lo, {side('>')} AS hi FROM {p}{k} m JOIN {p}{k} o ON m.g = o.g AND m.rank // 8 = o.rank // 8 WHERE m.n > 1 GROUP BY 1, 2)"
            )
        out.append(f"{p}roots AS (" + " UNION ALL ".join(f"SELECT g, digest FROM {p}{k} WHERE n = 1" for k in range(levels + 1)) + ")")
        return out

    rank = "(row_number() OVER (PARTITION BY g ORDER BY {}) - 1) AS rank, count(*) OVER (PARTITION BY g) AS n"
    parts = [
        f"d AS (SELECT *, coalesce('=' || lang, '') AS g, {leaf('text')} AS digest, CASE WHEN {crc} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS seen FROM documents)",
        *tree("l", f"SELECT doc_id, g, digest, {leaf('seen')} AS used, {rank.format('doc_id NULLS FIRST, digest')} FROM d", deep),
        *tree("t", "SELECT lroots.g AS name, 'all' AS g, digest, (row_number() OVER (ORDER BY lroots.g) - 1) AS rank, count(*) OVER () AS n FROM lroots", wide),
    ]
    last = "SELECT l0.doc_id, l0.g, l0.rank, l0.digest AS leaf, r.digest AS subroot, (SELECT digest FROM troots) AS root, used AS fold, '' AS proof, t0.rank AS top FROM l0 JOIN lroots r ON r.g = l0.g JOIN t0 ON t0.name = l0.g"
    for k, (p, key, at, power) in enumerate([("l", "c.g", "c.rank", k) for k in range(deep)] + [("t", "'all'", "c.top", k) for k in range(wide)]):
        parts.append(f"c{k} AS ({last})")
        last = (
            f"SELECT c.* REPLACE (CASE WHEN s.g IS NULL THEN fold ELSE sha256(lo || fold || hi) END AS fold, proof || coalesce(lo || hi, '') AS proof)"
            f" FROM c{k} c LEFT JOIN {p}s{power} s ON s.g = {key} AND s.rank = {at} // {8**power}"
        )
    parts.append(f"c AS ({last})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM c"


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": license_scan(), "op4_quality_rules": quality_rules(), "op6_url_filter": URL_FILTER, "op11_merkle_manifest": merkle_manifest()}
