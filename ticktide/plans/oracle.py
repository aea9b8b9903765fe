"""SQL over the given tables that the query checks are built from (named sub-queries)."""

from __future__ import annotations

from ticktide.functions.text import KEEP_TFIDF, LEGACY_TAG, LEGACY_URL, NOT_WORD, SPACE, TAG, URL, stop_list

# A small stop-word list for the test languages; the last two are kept finance words.
STOPWORDS = ("the", "and", "of", "is", "le", "la", "der", "und", "el", "de", "Buy", "ลง")
STOPPED = stop_list(STOPWORDS)
STOPPED_TFIDF = stop_list(STOPWORDS, KEEP_TFIDF)


def tokens_sql(stopped: list[str], text: str = "clean") -> str:
    """``text`` without stop-words and tokens of one character."""
    words = ", ".join(f"'{w}'" for w in stopped)
    return f"array_to_string(list_filter(string_split({text}, ' '), lambda x: length(x) > 1 AND x NOT IN ({words})), ' ')"


def pack(value: str, pos: str = "pos") -> str:
    """A vector held as (pos, value) rows, printed as whole millionths."""
    return f"string_agg(CAST(CAST(round({value} * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY {pos})"


CTE: dict[str, str] = {
    "symbols": """SELECT r_regionkey AS symbol_rank, r_name AS Stock, r_name || '.BK' AS Ticker,
        lower(r_name) || ' public company' AS name FROM region""",
    "lines": """SELECT r_name AS Stock, CAST(l_shipdate AS DATE) + CASE isodow(l_shipdate) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS Date,
        l_extendedprice / l_quantity AS price, l_quantity AS quantity,
        row(CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS seq
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "prices": """SELECT Stock, Date, arg_min(price, seq) AS Open, max(price) AS High, min(price) AS Low,
        arg_max(price, seq) AS Close, sum(quantity) AS Volume FROM lines GROUP BY Stock, Date""",
    "news": """SELECT doc_id AS news_id, Stock, DATE '1995-03-01' + CAST((doc_id * 37) % 250 AS INTEGER) AS Date,
        text AS Title, source AS Source, 'doc/' || doc_id AS Link
        FROM documents JOIN symbols ON n_chars % 5 = symbol_rank""",
    "kept": """SELECT *, Date + 1 AS Target_Date FROM news
        QUALIFY row_number() OVER (PARTITION BY Stock, Title ORDER BY news_id) = 1""",
    "vectors": """SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos
        FROM embeddings""",
    "doc_vec": """SELECT doc_id AS news_id, pos, x FROM documents
        JOIN vectors ON vec_id = doc_id % (SELECT count(*) FROM embeddings)""",
    "pooled": """SELECT Stock, Target_Date, pos, avg(x) AS m, count(*) AS n_news
        FROM kept JOIN doc_vec USING (news_id) GROUP BY Stock, Target_Date, pos""",
    "labelled": """SELECT *, CASE WHEN Open > Prev_Close THEN 1 ELSE 0 END AS Target_Label FROM (
        SELECT *, lag(Close) OVER (PARTITION BY Stock ORDER BY Date) AS Prev_Close FROM prices)
        WHERE Prev_Close IS NOT NULL""",
    "cells": """SELECT p.Stock, p.Target_Date, p.pos, p.m, p.n_news, l.Open, l.Prev_Close, l.High, l.Low, l.Close,
        l.Volume, l.Target_Label FROM pooled p JOIN labelled l ON l.Stock = p.Stock AND l.Date = p.Target_Date""",
    "panel": """SELECT Stock, Target_Date, any_value(Open) AS Open, any_value(Prev_Close) AS Prev_Close,
        any_value(High) AS High, any_value(Low) AS Low, any_value(Close) AS Close, any_value(Volume) AS Volume,
        any_value(Target_Label) AS Target_Label, any_value(n_news) AS n_news, list(m ORDER BY pos) AS vec
        FROM cells GROUP BY Stock, Target_Date""",
    "split": """SELECT *, CASE WHEN rn <= CAST(floor(CAST(n_rows AS DOUBLE) * CAST(0.70 AS DOUBLE)) AS INTEGER) THEN 'train'
        WHEN rn <= CAST(floor(CAST(n_rows AS DOUBLE) * CAST(0.70 AS DOUBLE)) AS INTEGER)
                 + CAST(floor(CAST(n_rows AS DOUBLE) * CAST(0.15 AS DOUBLE)) AS INTEGER) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY Stock ORDER BY Target_Date) AS INTEGER) AS rn,
        CAST(count(*) OVER (PARTITION BY Stock) AS INTEGER) AS n_rows FROM panel)""",
    "scored": """SELECT Stock, Target_Date, Target_Label AS y_true, model,
        least(greatest(round(0.5 + 2 * vec[k], 3), 0), 1) AS y_prob
        FROM panel CROSS JOIN (VALUES ('lstm', 2), ('rf', 3), ('svm', 4)) AS m(model, k)""",
    "confusion": """SELECT model, Stock, count(*) FILTER (y_true = 0 AND y_prob < 0.5) AS tn,
        count(*) FILTER (y_true = 0 AND y_prob >= 0.5) AS fp, count(*) FILTER (y_true = 1 AND y_prob < 0.5) AS fn,
        count(*) FILTER (y_true = 1 AND y_prob >= 0.5) AS tp FROM scored GROUP BY model, Stock""",
    "ranked": """SELECT *, rank() OVER (PARTITION BY model, Stock ORDER BY y_prob)
        + (count(*) OVER (PARTITION BY model, Stock, y_prob) - 1) / 2.0 AS r FROM scored""",
    "auc": """SELECT model, Stock, CASE WHEN n1 * n0 = 0 THEN 0.5 ELSE (s - n1 * (n1 + 1) / 2.0) / (n1 * n0) END AS auc_roc
        FROM (SELECT model, Stock, CAST(sum(y_true) AS DOUBLE) AS n1, CAST(count(*) - sum(y_true) AS DOUBLE) AS n0,
        sum(r) FILTER (y_true = 1) AS s FROM ranked GROUP BY model, Stock)""",
    "rates": """SELECT *, tn + fp + fn + tp AS n_test, (tp + tn) / (tn + fp + fn + tp) AS accuracy,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision_up,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall_up,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_score FROM confusion""",
    "report": """SELECT r.model, r.Stock, n_test, CAST(printf('%.4f', CAST(accuracy AS DOUBLE)) AS DOUBLE) AS accuracy, CAST(printf('%.4f', CAST(f1_score AS DOUBLE)) AS DOUBLE) AS f1_score,
        CAST(printf('%.4f', CAST(auc_roc AS DOUBLE)) AS DOUBLE) AS auc_roc, CAST(printf('%.4f', CAST(precision_up AS DOUBLE)) AS DOUBLE) AS precision_up, CAST(printf('%.4f', CAST(recall_up AS DOUBLE)) AS DOUBLE) AS recall_up
        FROM rates r JOIN auc a ON a.model = r.model AND a.Stock = r.Stock""",
    "feed": """SELECT event_id AS item_id, symbol_rank, Stock, ts,
        event_type || '/' || json_extract_string(props, '$.k') || '/' || strftime(ts, '%Y%m%d%H') AS Link,
        'Item ' || event_type || ' ' || json_extract_string(props, '$.k') AS Title, event_type, value
        FROM events JOIN symbols ON user_id % 5 = symbol_rank""",
    "published": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'about ' || strftime(ts, '%Y')
        ELSE strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT' END AS published FROM events""",
    "titles": """SELECT 'd' || doc_id AS id, CASE lang WHEN 'en' THEN '<b>' || text || '</b> - ' || source
        WHEN 'fr' THEN text || ' | ' || source || ' - ' || lang
        WHEN 'de' THEN 'https://news.example/' || source || ' www.x.example ' || text ELSE text END AS Title FROM documents
        UNION ALL SELECT 'p' || page_id, html || ' ' || url || ' - ' || url FROM pages""",
    "untagged": """SELECT id, CASE WHEN contains(a, ' | ') THEN regexp_extract(a, '(?s)^(.*) \\| ', 1) ELSE a END AS t FROM (
        SELECT id, CASE WHEN contains(Title, ' - ') THEN regexp_extract(Title, '(?s)^(.*) - ', 1) ELSE Title END AS a FROM titles)""",
    "clean": f"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '{TAG}', '', 'g'),
        '{URL}', '', 'g'), '{NOT_WORD}', '', 'g'), '[{SPACE}]+', ' ', 'g')) AS clean FROM untagged""",
    "clean_serving": f"""SELECT id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '{TAG}|{URL}', '', 'g'),
        '{NOT_WORD}', '', 'g'), '[{SPACE}]+', ' ', 'g')), ''), 'ข่าวหุ้น') AS clean FROM untagged""",
    "clean_legacy": f"""SELECT id, trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(lower(t),
        '{LEGACY_TAG}', '', 'g'), '{LEGACY_URL}', '', 'g'), '{NOT_WORD}', '', 'g'), chr(10) || chr(13), ' '),
        '[{SPACE}]+', ' ', 'g')) AS clean FROM untagged""",
    "cleaned": f"""SELECT news_id, Stock, Target_Date, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(
        CASE WHEN contains(Title, ' | ') THEN regexp_extract(Title, '(?s)^(.*) \\| ', 1) ELSE Title END), '{TAG}', '', 'g'),
        '{URL}', '', 'g'), '{NOT_WORD}', '', 'g'), '[{SPACE}]+', ' ', 'g')) AS clean FROM kept""",
    "articles": f"SELECT news_id, Stock, Target_Date, {tokens_sql(STOPPED_TFIDF)} AS Processed FROM cleaned",
    "words": """SELECT news_id, pos, w FROM (SELECT news_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos
        FROM (SELECT news_id, list_filter(string_split(Processed, ' '), lambda x: length(x) >= 2) AS l FROM articles))""",
    "gram_counts": """SELECT news_id, term, CAST(count(*) AS INTEGER) AS tf FROM (SELECT news_id, w AS term FROM words
        UNION ALL SELECT a.news_id, a.w || ' ' || b.w FROM words a JOIN words b ON a.news_id = b.news_id AND b.pos = a.pos + 1)
        GROUP BY news_id, term""",
    "cutoff": """SELECT Target_Date AS cutoff FROM (SELECT Target_Date, row_number() OVER (ORDER BY Target_Date) - 1 AS i,
        count(*) OVER () AS n FROM (SELECT DISTINCT Target_Date FROM kept))
        WHERE i = CAST(floor(CAST(n AS DOUBLE) * CAST(0.70 AS DOUBLE)) AS INTEGER)""",
    "vocabulary": """SELECT term, df, cf, ln((n + 1.0) / (df + 1.0)) + 1.0 AS idf FROM (
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM gram_counts JOIN articles USING (news_id)
        WHERE Target_Date <= (SELECT cutoff FROM cutoff) GROUP BY term)
        CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM articles WHERE Target_Date <= (SELECT cutoff FROM cutoff))
        WHERE df >= 2 AND df <= CAST(0.85 AS DOUBLE) * n ORDER BY cf DESC, term LIMIT 400""",
    "weights": """SELECT news_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY news_id)) AS weight FROM (
        SELECT news_id, term, (1 + ln(CAST(tf AS DOUBLE))) * idf AS w FROM gram_counts JOIN vocabulary USING (term))""",
    "last_bars": """SELECT *, CAST(row_number() OVER (PARTITION BY Stock ORDER BY Date DESC) AS INTEGER) AS back FROM prices""",
    "both_groups": """SELECT Stock AS grp, *, concat_ws('|', Stock, CAST(Target_Date AS VARCHAR)) AS key FROM panel
        UNION ALL SELECT 'ALL', *, concat_ws('|', Stock, CAST(Target_Date AS VARCHAR)) FROM panel""",
    "latest_signal": """SELECT Stock, model, probability_up, confidence, signal, label, Target_Date FROM (
        SELECT Stock, model, Target_Date, CAST(printf('%.4f', CAST(y_prob AS DOUBLE)) AS DOUBLE) AS probability_up,
        CAST(printf('%.4f', CAST(CASE WHEN y_prob >= 0.5 THEN y_prob ELSE 1 - y_prob END AS DOUBLE)) AS DOUBLE) AS confidence,
        CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS signal, CASE WHEN y_prob >= 0.5 THEN 'Up' ELSE 'Down' END AS label,
        row_number() OVER (PARTITION BY Stock, model ORDER BY Target_Date DESC) AS rn FROM scored)
        WHERE rn = 1""",
    "feed_items": """SELECT Stock, Title AS headline, event_type AS source, strftime(ts, '%Y-%m-%d') AS date, Link AS link,
        CAST(epoch_us(ts) / 1000000.0 AS DOUBLE) AS timestamp,
        CAST(row_number() OVER (PARTITION BY Stock ORDER BY ts DESC, item_id) AS INTEGER) AS item_rank FROM feed""",
    "stored_items": """SELECT Stock, headline, source, date, link, CASE WHEN source = 'view' THEN NULL ELSE timestamp END AS timestamp,
        item_rank FROM feed_items WHERE item_rank <= 10 AND Stock IN (SELECT Stock FROM feed GROUP BY Stock
        HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM feed GROUP BY Stock)))""",
    "quotes": """SELECT s.Stock, CASE WHEN n = 2 THEN printf('%.2f', cur) ELSE '-' END AS price,
        CASE WHEN n = 2 THEN (CASE WHEN cur - prev >= 0 THEN '+' ELSE '' END) || printf('%.2f', cur - prev) || ' ('
          || (CASE WHEN cur - prev >= 0 THEN '+' ELSE '' END)
          || printf('%.2f', CASE WHEN prev <> 0 THEN (cur - prev) / prev * 100 ELSE 0 END) || '%)' ELSE '-' END AS change,
        coalesce(CASE WHEN n = 2 THEN cur - prev >= 0 END, true) AS is_positive
        FROM symbols s LEFT JOIN (SELECT Stock, max(Close) FILTER (back = 1) AS cur, max(Close) FILTER (back = 2) AS prev,
        count(*) AS n FROM last_bars WHERE back <= 2 GROUP BY Stock) q ON q.Stock = s.Stock""",
}

NEEDS: dict[str, tuple[str, ...]] = {
    "prices": ("lines",), "news": ("symbols",), "kept": ("news",), "doc_vec": ("vectors",), "pooled": ("kept", "doc_vec"),
    "labelled": ("prices",), "cells": ("pooled", "labelled"), "panel": ("cells",), "split": ("panel",), "scored": ("panel",),
    "confusion": ("scored",), "ranked": ("scored",), "auc": ("ranked",), "rates": ("confusion",), "report": ("rates", "auc"),
    "feed": ("symbols",), "untagged": ("titles",), "clean": ("untagged",), "clean_serving": ("untagged",),
    "clean_legacy": ("untagged",), "cleaned": ("kept",), "articles": ("cleaned",), "words": ("articles",), "gram_counts": ("words",),
    "cutoff": ("kept",), "vocabulary": ("gram_counts", "cutoff", "articles"), "weights": ("gram_counts", "vocabulary"),
    "last_bars": ("prices",), "both_groups": ("panel",), "latest_signal": ("scored",),
    "feed_items": ("feed",), "stored_items": ("feed_items",), "quotes": ("symbols", "last_bars"),
}


def with_views(needed: str, body: str, **more: str) -> str:
    """``body`` behind a WITH clause of the named views, what they need, and ``more`` of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, ()):
            add(dep)
        if name not in order:
            order.append(name)

    for name in needed.split():
        add(name)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
