"""The queries of runner_queries as SQL for an independent engine: seeds by their place in their fifth, links to the first wave that reaches them, whatever their case."""

from .oracle import _LINKS, _normal

ORACLE = {
    "runner_waves": f"""WITH {_LINKS}, p AS (SELECT {_normal('url')} AS url, min(page_id) AS page_id FROM pages GROUP BY 1), e AS (SELECT DISTINCT {_normal('p.url')} AS parent, l.target AS child FROM links l JOIN pages p USING (page_id)),
o AS (SELECT *, page_id % 5 AS k, row_number() OVER (PARTITION BY page_id % 5 ORDER BY url) - 1 AS i FROM p),
seeds AS (SELECT url, 'graph' AS runner, 0 AS wave, 0 AS round, 0 AS turn FROM o WHERE k = 0 UNION ALL SELECT url, 'wide', i // 3, i // 3 + 1, 1 FROM o WHERE k = 1 AND i < 12
 UNION ALL SELECT url, 'still', i // 2, i // 2 + 1, 2 FROM o WHERE k = 2 AND i < 4 UNION ALL SELECT url, 'all', 0, 1, 3 FROM o WHERE k = 3),
found AS (SELECT * FROM seeds UNION ALL SELECT child, runner, wave, round, turn FROM seeds JOIN e ON parent = url WHERE runner <> 'still'),
one AS (SELECT url, arg_min({{'runner': runner, 'wave': wave, 'round': round}}, round * 10 + turn) AS x, min(round * 10 + turn) AS first FROM found GROUP BY 1 QUALIFY min(round * 10 + turn) = min(min(round * 10 + turn)) OVER (PARTITION BY lower(url)))
SELECT x.runner AS runner, x.wave AS wave, x.round AS round, count(*) AS n_pages FROM one GROUP BY ALL""",
}
