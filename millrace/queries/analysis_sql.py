"""DuckDB SQL of the log analysis: tokens, similarity and clusters, for the oracles of K2 to K7.

Clusters are found by rounds here, where the library places signatures one by one: the
k-th pattern of a window is its first signature that none of the earlier ones takes.
"""

from __future__ import annotations

_CUTTERS = r"[)!;@\[(,?}\]:^&={*]|->| - |，|【|。|（|）|】|！|；|："


def words(lines: str) -> str:
    """SQL of the rows of `lines`, with words: list of (letters, size, source, important)."""
    return f"""(
        SELECT *, list_transform(list_filter(list_transform(string_split_regex(rest, '{_CUTTERS}'), lambda w: trim(w, ' ')), lambda w: w <> ''), lambda w: {{
            'letters': regexp_replace(w, '[^A-Za-z]', '', 'g'), 'size': strlen(w),
            'source': strlen(w) > 5 AND (regexp_matches(w, '^(com|java|org)[.]') OR ends_with(w, '.com') OR regexp_matches(w, '([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}')),
            'important': strlen(w) > 10 AND length(regexp_replace(w, '[^._-]', '', 'g')) < 2 AND length(regexp_replace(w, '[^A-Za-z ]', '', 'g')) > CAST(0.9 AS DOUBLE) * strlen(w)}}) AS words
        FROM (SELECT *, CASE WHEN strlen(cut) > 23 AND substr(cut, 5, 1) = '-' AND substr(cut, 8, 1) = '-' THEN substr(cut, 24) ELSE cut END AS rest
            FROM (SELECT *, CASE WHEN strlen(line) <= 300 THEN line ELSE left(line, whole) || CASE WHEN strlen(left(line, whole)) < 300 THEN chr(65533) ELSE '' END END AS cut
                FROM (SELECT *, CASE WHEN strlen(line) > 300 THEN list_max(list_filter(range(0, 301), lambda k: strlen(left(line, CAST(k AS INTEGER))) <= 300)) END AS whole FROM {lines}))))"""


_SIMILAR = """CASE WHEN len(u.words) = 0 OR len(p.pattern) = 0 THEN len(u.words) = len(p.pattern)
            WHEN least(len(u.words), len(p.pattern)) / greatest(len(u.words), len(p.pattern)) < CAST(0.8 AS DOUBLE) THEN false
            ELSE u.total = 0 OR list_sum(list_transform(u.counted, lambda t: CASE WHEN NOT list_contains(p.letters, t.letters) THEN 0 WHEN t.important THEN 2 * t.size ELSE t.size END)) / u.total >= CAST(0.8 AS DOUBLE) END"""


def clusters(lines: str, most: int) -> str:
    """SQL of CTEs that end in clusters (window_start, cluster, count, line), of a table `lines` (window_start, seq, line)."""
    steps = [f"""signed AS MATERIALIZED (SELECT window_start, words, min(seq) AS seq, count(*) AS n, min_by(line, seq) AS line FROM {words(lines)} GROUP BY window_start, words)""",
        """left_0 AS MATERIALIZED (SELECT *, coalesce(list_sum(list_transform(counted, lambda t: CASE WHEN t.important THEN t.size ELSE t.size // 2 END)), 0) AS total
            FROM (SELECT *, list_filter(words, lambda t: NOT t.source AND t.size >= 5) AS counted FROM signed))"""]
    for k in range(most):
        steps += [f"opens_{k} AS MATERIALIZED (SELECT window_start, min_by(words, seq) AS pattern, list_transform(min_by(words, seq), lambda t: t.letters) AS letters FROM left_{k} GROUP BY window_start)",
            f"met_{k} AS MATERIALIZED (SELECT u.*, {_SIMILAR} AS hit FROM left_{k} u JOIN opens_{k} p USING (window_start))",
            f"left_{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (hit) FROM met_{k} WHERE NOT hit)"]
    found = " UNION ALL ".join(f"SELECT window_start, {k} AS cluster, CAST(sum(n) AS BIGINT) AS count, min_by(line, seq) AS line FROM met_{k} WHERE hit GROUP BY window_start" for k in range(most))
    return ",\n    ".join([*steps, f"clusters AS MATERIALIZED ({found})"])
