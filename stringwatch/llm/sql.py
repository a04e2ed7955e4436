"""SQL that gives the rows of a query, where SQL can say it."""

MIXING = """
WITH counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
    SELECT source, (SELECT sum(n) FROM counted) / (SELECT count(*) FROM counted)::DOUBLE / n AS rate FROM counted
),
terms AS (
    SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
    FROM rates, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS series(k)
),
tables AS (SELECT source, list(c ORDER BY k) AS cdf FROM (
    SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) AS summed GROUP BY source
),
drawn AS (
    SELECT doc_id, source, text,
        len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('17:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0)) AS number
    FROM documents JOIN tables USING (source)
)
SELECT doc_id, source, copy_no::INTEGER AS copy_no, md5('17:order:' || doc_id || ':' || copy_no) AS shuffle_key, md5(text) AS text_md5
FROM drawn, unnest(generate_series(1, number)) AS copies(copy_no)
"""
