"""Plain SQL that gives the same rows as the queries of `catalog`, for checks in DuckDB."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

SECOND = 1440
ITEMS = ["IT00", "IT01", "IT02", "IT03"]
STATS = ["attempt_times", "attempt_mean_time", "attempt_min_time"]

# The views below may use those above them; `sql` puts the needed ones before a query.
VIEWS = {
    "log": """
        SELECT user_id AS student_id, event_id AS seq, ts AS event_time,
               'IT0' || CAST(item_no AS VARCHAR) AS item_id,
               CASE item_no WHEN 0 THEN 'FillInBlank' WHEN 1 THEN 'MultipleFillInBlank'
                            WHEN 2 THEN 'CompositeCR' ELSE 'MatchMS' END AS item_type,
               CASE event_type WHEN 'signup' THEN 'Enter Item' WHEN 'click' THEN 'Click Choice'
                    WHEN 'view' THEN 'Vertical Item Scroll'
                    WHEN 'error' THEN 'Click Progress Navigator'
                    ELSE CASE WHEN item_no = 3 THEN 'DropChoice' ELSE 'Math Keypress' END
               END AS observable,
               CASE event_type
                    WHEN 'click' THEN 'IT0' || CAST(item_no AS VARCHAR) || '_' || CAST(k % 5 + 1 AS VARCHAR) || ':checked'
                    WHEN 'view' THEN CAST(k AS VARCHAR) || ',' || CAST(k * 3 AS VARCHAR) || ',0'
                    WHEN 'purchase' THEN CASE WHEN item_no = 3
                         THEN '[{"source":"' || CAST(k % 4 + 1 AS VARCHAR) || '","target":'
                              || CAST(CAST(FLOOR(k / 4) AS INT) % 4 + 1 AS VARCHAR) || '}]'
                         ELSE '{"code":"' || CASE WHEN k < 70 THEN 'Digit' || CAST(k % 10 AS VARCHAR)
                                                  WHEN k < 80 THEN 'Period'
                                                  WHEN k < 95 THEN 'Backspace' ELSE 'KeyX' END
                              || '","numericIdentifier":"' || CAST(k % 5 + 1 AS VARCHAR)
                              || '","partId":"' || CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END
                              || '"}' END
               END AS ext_info
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
                     CAST(FLOOR((day(ts) - 1) / 3) AS INT) % 4 AS item_no FROM events) e""",
    "students": "SELECT DISTINCT student_id FROM log",
    "elapsed": """
        SELECT *, epoch_us(event_time) - min(epoch_us(event_time)) OVER (PARTITION BY student_id) AS us
        FROM log""",
    "clean": """
        SELECT * FROM log
        WHERE observable IS DISTINCT FROM 'Click Progress Navigator'
          AND coalesce(item_id, '') NOT IN ('BlockRev', 'EOSTimeLft', 'HELPMAT8', 'SecTimeOut')""",
    "flagged": """
        SELECT *, CASE WHEN item_id = lag(item_id) OVER w THEN 0 ELSE 1 END AS item_start,
               CASE WHEN item_id = lag(item_id) OVER w AND observable = lag(observable) OVER w
                    THEN 0 ELSE 1 END AS verb_start
        FROM clean WINDOW w AS (PARTITION BY student_id ORDER BY event_time, seq)""",
    "visited": """
        SELECT *, CAST(sum(item_start) OVER (PARTITION BY student_id, item_id ORDER BY event_time, seq)
                       AS BIGINT) AS attempt FROM flagged""",
    "numbered": """
        SELECT *, CAST(sum(verb_start) OVER (PARTITION BY student_id, item_id, attempt
                                             ORDER BY event_time, seq) AS BIGINT) AS verb_run
        FROM visited""",
    "durations": """
        SELECT student_id, item_id, attempt,
               epoch_us(max(event_time)) - epoch_us(min(event_time)) AS micros, micros / 1e6 AS duration
        FROM numbered GROUP BY student_id, item_id, attempt""",
    "item_stats": """
        SELECT student_id, item_id, count(duration) AS attempt_times,
               sum(micros) / 1e6 / count(*) AS attempt_mean_time, min(duration) AS attempt_min_time
        FROM durations GROUP BY student_id, item_id""",
    "zscores": """
        SELECT *, (duration - avg(duration) OVER w) / nullif(stddev_samp(duration) OVER w, 0) AS z
        FROM durations WINDOW w AS (PARTITION BY item_id)""",
    "student_stats": """
        SELECT student_id,
               count(DISTINCT CASE WHEN z > -1.5 THEN item_id END) / 4.0 AS valid_question_attempt_percent,
               sum(micros) / 1e6 / count(*) AS question_attempt_mean_time,
               stddev_samp(duration) AS question_attempt_std_time,
               avg(z) AS scaled_question_attempt_mean_time,
               stddev_pop(z) AS scaled_question_attempt_std_time
        FROM zscores GROUP BY student_id""",
    "chains": """
        SELECT student_id, item_id, attempt,
               string_agg(DISTINCT observable, ',' ORDER BY observable) AS verb_chain
        FROM numbered GROUP BY student_id, item_id, attempt""",
    "chain_counted": """
        SELECT item_id, verb_chain, count(*) AS attempts FROM chains GROUP BY item_id, verb_chain""",
    "top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id
                                                    ORDER BY attempts DESC, verb_chain) AS rank
                       FROM chain_counted) r
        WHERE rank <= 10 AND attempts > 20""",
    "common": """
        SELECT c.student_id, c.item_id, c.attempt,
               CASE WHEN t.rank IS NULL THEN 'OtherActions' ELSE c.verb_chain END AS verb_chain
        FROM chains c LEFT JOIN top t USING (item_id, verb_chain)""",
    "chain_featured": """
        SELECT student_id, feature, CAST(count(*) AS DOUBLE) AS value
        FROM (SELECT student_id, 'm_' || item_id || '_' || CAST(attempt AS VARCHAR) || '_' || verb_chain
                     AS feature FROM common) f
        WHERE feature IN (SELECT 'm_' || item_id || '_' || CAST(attempt AS VARCHAR) || '_' || verb_chain
                          FROM common GROUP BY 1 HAVING count(*) >= 10)
        GROUP BY student_id, feature""",
    "verb_durations": """
        SELECT *, CASE WHEN lead(item_id) OVER w = item_id
                       THEN (epoch_us(lead(event_time) OVER w) - epoch_us(event_time)) / 1e6
                       ELSE 0.0 END AS verb_duration
        FROM clean WINDOW w AS (PARTITION BY student_id ORDER BY event_time, seq)""",
    "levels": """
        SELECT *, coalesce(floor(verb_duration / nullif((SELECT stddev_samp(verb_duration) / 2000
                                                         FROM verb_durations), 0)), 0) AS duration_level
        FROM verb_durations""",
    "firsts": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id, item_id, item_type, attempt, verb_run
                                                    ORDER BY event_time, seq) AS rn FROM numbered) f
        WHERE rn = 1""",
    "first_durations": """
        SELECT *, CASE WHEN lead(item_id) OVER w = item_id
                       THEN (epoch_us(lead(event_time) OVER w) - epoch_us(event_time)) / 1e6
                       ELSE 0.0 END AS verb_duration,
               row_number() OVER w - 1 AS position
        FROM firsts WINDOW w AS (PARTITION BY student_id ORDER BY event_time, seq)""",
    "tokens": """
        SELECT student_id, position,
               item_id || '_' || observable || '_('
               || CAST(CAST(coalesce(floor(verb_duration / nullif((SELECT stddev_samp(verb_duration) / 2000
                                                          FROM first_durations), 0)), 0) AS BIGINT) AS VARCHAR)
               || ')' AS token
        FROM first_durations""",
    "padded": """
        SELECT s.student_id, p.position, coalesce(t.token, '') AS token
        FROM (SELECT DISTINCT student_id FROM tokens) s
        CROSS JOIN (SELECT DISTINCT position FROM tokens) p
        LEFT JOIN tokens t ON t.student_id = s.student_id AND t.position = p.position""",
    "grouped": """
        SELECT student_id, seq, event_time, item_id, item_type,
               CASE WHEN observable IN ('Vertical Item Scroll', 'Horizontal Item Scroll') THEN 'Scroll'
                    ELSE observable END AS observable
        FROM log""",
    "minute_rows": """
        SELECT l.student_id, l.seq, l.event_time, l.item_type, l.duration_level, g.observable,
               (epoch_us(l.event_time) - min(epoch_us(l.event_time)) OVER (PARTITION BY l.student_id))
               // 86400000000 AS minute
        FROM levels l JOIN grouped g USING (seq)""",
    "minute_kept": "SELECT * FROM minute_rows WHERE duration_level < 10",
    "minute_counted": """
        SELECT student_id, minute, sum(duration_level) AS duration_level, count(*) AS verb_count,
               count(DISTINCT observable) AS unique_verb_count,
               list_sort(list(DISTINCT observable)) AS unique_verbs
        FROM minute_kept GROUP BY student_id, minute""",
    "minute_grid": """
        SELECT s.student_id, m.minute, coalesce(c.duration_level, 0.0) AS duration_level,
               coalesce(c.verb_count, 0) AS verb_count,
               coalesce(c.unique_verb_count, 0) AS unique_verb_count,
               CASE WHEN c.unique_verbs IS NULL THEN '0'
                    ELSE '["' || array_to_string(c.unique_verbs, '","') || '"]' END AS unique_verb_chain
        FROM (SELECT DISTINCT student_id FROM minute_counted) s
        CROSS JOIN (SELECT unnest(range((SELECT max(minute) + 1 FROM minute_counted))) AS minute) m
        LEFT JOIN minute_counted c ON c.student_id = s.student_id AND c.minute = m.minute""",
    "combined": """
        SELECT student_id, seq, event_time, item_id, item_type,
               observable || '_' || coalesce(CASE observable
                   WHEN 'Click Choice' THEN regexp_extract(ext_info, '_([0-9]):', 1)
                   WHEN 'DropChoice' THEN CAST((length(ext_info) - length(replace(ext_info, 'source', ''))) // 6 AS VARCHAR)
                   WHEN 'Vertical Item Scroll' THEN split_part(ext_info, ',', 1) || '_' || split_part(ext_info, ',', 2)
                   WHEN 'Math Keypress' THEN '' ELSE ext_info END, '') AS observable
        FROM log WHERE event_time IS NOT NULL""",
    "binned": f"""
        SELECT * FROM (
            SELECT *, us // {SECOND * 10**6} AS occur_second,
                   coalesce(lead(us) OVER (PARTITION BY student_id ORDER BY event_time, seq) - us, 0)
                   / ({SECOND} * 1e6) AS verb_duration
            FROM (SELECT *, epoch_us(event_time) - min(epoch_us(event_time)) OVER (PARTITION BY student_id) AS us
                  FROM combined) e) b
        WHERE occur_second <= 1800""",
    "last_rows": """
        SELECT student_id, occur_second, item_id, item_type, observable, verb_duration
        FROM (SELECT *, row_number() OVER (PARTITION BY student_id, occur_second
                                           ORDER BY event_time DESC, seq DESC) AS rn FROM binned) r
        WHERE rn = 1""",
    "grid": """
        SELECT s.student_id, g.occur_second, l.item_id, l.item_type, l.observable, l.verb_duration,
               max(l.occur_second) OVER (PARTITION BY s.student_id) AS last_second
        FROM (SELECT DISTINCT student_id FROM last_rows) s
        CROSS JOIN (SELECT unnest(range(1801)) AS occur_second) g
        LEFT JOIN last_rows l ON l.student_id = s.student_id AND l.occur_second = g.occur_second""",
    "dense": """
        SELECT student_id, occur_second,
               CASE WHEN occur_second > last_second THEN '0'
                    ELSE last_value(item_id IGNORE NULLS) OVER w END AS item_id,
               CASE WHEN occur_second > last_second THEN '0'
                    ELSE last_value(item_type IGNORE NULLS) OVER w END AS item_type,
               CASE WHEN occur_second > last_second THEN '0'
                    ELSE last_value(observable IGNORE NULLS) OVER w END AS observable,
               last_value(verb_duration IGNORE NULLS) OVER w AS verb_duration
        FROM grid
        WINDOW w AS (PARTITION BY student_id ORDER BY occur_second
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "coded": """
        SELECT student_id, occur_second,
               dense_rank() OVER (ORDER BY item_id) - 1 AS item_id,
               dense_rank() OVER (ORDER BY item_type) - 1 AS item_type,
               dense_rank() OVER (ORDER BY observable) - 1 AS observable
        FROM dense""",
    "forced": """
        SELECT student_id, seq, event_time, observable, ext_info, item_id AS row_item,
               coalesce(last_value(CASE WHEN observable = 'Enter Item' THEN item_id END IGNORE NULLS) OVER w,
                        first_value(item_id) OVER w) AS item_id
        FROM log
        WINDOW w AS (PARTITION BY student_id ORDER BY event_time, seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "visits": """
        SELECT *, sum(CASE WHEN observable = 'Enter Item' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY student_id, item_id ORDER BY event_time, seq) AS visit
        FROM forced""",
    "inside": """
        SELECT * FROM visits WHERE visit > 0 AND observable NOT IN ('Enter Item', 'Exit Item')""",
    "choices": """
        SELECT student_id, item_id, arg_max(split_part(ext_info, ':', 1)[-1:], (event_time, seq)) AS answer
        FROM inside WHERE observable = 'Click Choice' GROUP BY student_id, item_id""",
    "keys": """
        SELECT student_id, item_id, event_time, seq,
               CAST(regexp_extract(ext_info, '"numericIdentifier":"([0-9]+)"', 1) AS INT) - 1 AS number,
               CASE regexp_extract(ext_info, '"partId":"([A-C])"', 1)
                    WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS part,
               CASE regexp_extract(ext_info, '"code":"([A-Za-z0-9]+)"', 1)
                    WHEN 'Backspace' THEN '<' WHEN 'Period' THEN '.' WHEN 'KeyX' THEN 'X'
                    ELSE regexp_extract(ext_info, '"code":"Digit([0-9])"', 1) END AS typed
        FROM inside WHERE observable = 'Math Keypress'""",
    "typed_blanks": """
        SELECT v.student_id, v.item_id, b.blank,
               list_reduce(list_prepend('', coalesce(t.typed, [])),
                           lambda kept, key: CASE WHEN key <> '<' THEN kept || key
                                                  WHEN length(kept) <= 1 THEN ''
                                                  ELSE left(kept, length(kept) - 1) END) AS text
        FROM (SELECT DISTINCT student_id, item_id FROM visits WHERE visit > 0) v
        JOIN (SELECT 'IT00' AS item_id, 0 AS blank UNION ALL
              SELECT 'IT01', unnest(range(5)) UNION ALL
              SELECT 'IT02', unnest(range(3))) b USING (item_id)
        LEFT JOIN (SELECT student_id, item_id,
                          CASE item_id WHEN 'IT00' THEN 0 WHEN 'IT01' THEN number ELSE part END AS blank,
                          list(typed ORDER BY event_time, seq) AS typed
                   FROM keys GROUP BY 1, 2, 3) t
          ON t.student_id = v.student_id AND t.item_id = v.item_id AND t.blank = b.blank""",
    "blank_texts": """
        SELECT student_id, item_id, list(text ORDER BY blank) AS slots
        FROM typed_blanks GROUP BY student_id, item_id""",
    "drops": """
        SELECT student_id, item_id,
               CAST(regexp_extract(ext_info, '"source":"([0-9])"', 1) AS INT) AS source,
               arg_max(regexp_extract(ext_info, '"target":([0-9])', 1), (event_time, seq)) AS target
        FROM inside WHERE observable = 'DropChoice' GROUP BY 1, 2, 3""",
    "matches": """
        SELECT student_id, item_id,
               [max(target) FILTER (source = 1), max(target) FILTER (source = 2),
                max(target) FILTER (source = 3), max(target) FILTER (source = 4)] AS slots
        FROM drops GROUP BY student_id, item_id""",
    "seen": "SELECT DISTINCT student_id, item_id FROM visits",
    "items": "SELECT unnest(['IT00', 'IT01', 'IT02', 'IT03']) AS item_id",
    "responded": """
        SELECT s.student_id, i.item_id,
               CASE i.item_id WHEN 'IT00' THEN CASE WHEN b.slots[1] <> '' THEN b.slots END
                    WHEN 'IT01' THEN CASE WHEN n.student_id IS NOT NULL
                                          THEN coalesce(b.slots, ['', '', '', '', '']) END
                    WHEN 'IT02' THEN CASE WHEN n.student_id IS NOT NULL THEN coalesce(b.slots, ['', '', '']) END
                    ELSE m.slots END AS slots,
               n.student_id IS NOT NULL AS was_seen
        FROM students s CROSS JOIN items i
        LEFT JOIN seen n ON n.student_id = s.student_id AND n.item_id = i.item_id
        LEFT JOIN blank_texts b ON b.student_id = s.student_id AND b.item_id = i.item_id
        LEFT JOIN matches m ON m.student_id = s.student_id AND m.item_id = i.item_id AND i.item_id = 'IT03'""",
    "scored": """
        SELECT student_id, item_id, slots,
               CASE WHEN slots IS NOT NULL THEN 'answered' WHEN was_seen THEN 'N_A' ELSE 'N_D' END AS status,
               CASE WHEN slots IS NULL THEN NULL
                    WHEN item_id = 'IT00' THEN CAST(slots[1] = '5' AS BIGINT)
                    WHEN item_id = 'IT01' THEN CAST(slots[1] = '3' AS BIGINT) + CAST(slots[2] = '5' AS BIGINT)
                         + CAST(slots[3] = '6' AS BIGINT) + CAST(slots[4] = '7' AS BIGINT)
                         + CAST(slots[5] = '8' AS BIGINT)
                    WHEN item_id = 'IT02' THEN CAST(slots[1] = '0' AS BIGINT) + CAST(slots[2] = '1' AS BIGINT)
                         + CAST(slots[3] = '2' AS BIGINT)
                    ELSE coalesce(CAST(slots[1] = '2' AS BIGINT), 0) + coalesce(CAST(slots[2] = '3' AS BIGINT), 0)
                         + coalesce(CAST(slots[3] = '1' AS BIGINT), 0) + coalesce(CAST(slots[4] = '4' AS BIGINT), 0)
               END AS score
        FROM responded""",
    "choice_scored": """
        SELECT s.student_id, i.item_id, c.answer, n.student_id IS NOT NULL AS was_seen,
               CAST(c.answer = '2' AS BIGINT) AS score
        FROM students s CROSS JOIN items i
        LEFT JOIN seen n ON n.student_id = s.student_id AND n.item_id = i.item_id
        LEFT JOIN choices c ON c.student_id = s.student_id AND c.item_id = i.item_id""",
    "choice_text": """
        SELECT student_id, item_id,
               coalesce(answer, CASE WHEN was_seen THEN 'N_A' ELSE 'N_D' END) AS answer
        FROM choice_scored""",
    "easy_items": """
        SELECT item_id FROM choice_scored WHERE answer IS NOT NULL
        GROUP BY item_id ORDER BY avg(score) DESC, item_id LIMIT 1""",
    "passed": """
        SELECT student_id FROM choice_scored WHERE score = 1 AND item_id IN (SELECT item_id FROM easy_items)""",
    "rates": """
        SELECT item_id, observable, avg(student_id % 2) AS rate FROM combined GROUP BY item_id, observable""",
    "rate_bins": """
        SELECT item_id, observable,
               CAST(coalesce(least(floor((rate - (SELECT min(rate) FROM rates))
                    / nullif((SELECT (max(rate) - min(rate)) / 6 FROM rates), 0)) + 1, 6), 1) AS BIGINT) AS verb_weight
        FROM rates""",
    "guesses": """
        SELECT student_id, ((count(*) * 37 + student_id * 53) % 101) / 100.0 AS p,
               student_id % 2 AS truth, student_id % 3 AS fold
        FROM log GROUP BY student_id""",
    "fold_auc": """
        SELECT a.fold, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc
        FROM guesses a JOIN guesses b ON a.fold = b.fold AND a.truth = 1 AND b.truth = 0
        GROUP BY a.fold""",
}


def coefficient(intercept: str) -> str:
    """Newton's method for one pair's coefficient: 60 steps from where the slope is steepest."""
    p = f"(1 / (1 + exp(-(w + {intercept}))))"
    step = f"w - ((positive + negative) * {p} - positive + w) / ((positive + negative) * {p} * (1 - {p}) + 1)"
    return f"list_reduce([-{intercept}] || list_transform(range(60), lambda x: CAST(0 AS DOUBLE)), lambda w, x: {step})"


VIEWS["pair_events"] = """
        SELECT item_id, observable, count(*) FILTER (student_id % 2 = 1) AS yes, count(*) FILTER (student_id % 2 = 0) AS no
        FROM combined WHERE student_id % 4 <> 0 AND item_id IS NOT NULL AND observable IS NOT NULL GROUP BY 1, 2"""
VIEWS["pairs"] = """
        SELECT item_id, observable, coalesce(yes * ((yes_all + no_all) / (seen * nullif(yes_all, 0))), 0.0) AS positive,
               coalesce(no * ((yes_all + no_all) / (seen * nullif(no_all, 0))), 0.0) AS negative
        FROM pair_events, (SELECT sum(yes) AS yes_all, sum(no) AS no_all,
                                  CAST(sum(yes) > 0 AS INT) + CAST(sum(no) > 0 AS INT) AS seen FROM pair_events)"""
#: The intercept equals the sum of the coefficients: halved down to it.
VIEWS["fit"] = f"""
        SELECT 0, CAST(-1000 AS DOUBLE), CAST(1000 AS DOUBLE) UNION ALL
        SELECT step + 1, CASE WHEN gap > 0 THEN low ELSE mid END, CASE WHEN gap > 0 THEN mid ELSE high END
        FROM (SELECT step, low, high, mid, mid - sum({coefficient("mid")}) AS gap
              FROM (SELECT *, (low + high) / 2 AS mid FROM fit) f, pairs WHERE step < 70 GROUP BY step, low, high, mid)"""
VIEWS["weighed"] = f"""
        SELECT item_id, observable, {coefficient("b")} AS verb_weight
        FROM pairs, (SELECT low AS b FROM fit WHERE step = 70) i"""
VIEWS["weight_classes"] = """
        SELECT item_id, observable, CAST(CASE WHEN high > low
            THEN least(floor((verb_weight - low) / ((high - low) / 6)) + 1, 6) ELSE 1 END AS INT) AS verb_weight
        FROM weighed, (SELECT min(verb_weight) AS low, max(verb_weight) AS high FROM weighed) m"""
VIEWS["weight_places"] = """
        SELECT b.student_id, row_number() OVER (PARTITION BY b.student_id ORDER BY b.event_time, b.seq) - 1 AS position,
               coalesce(w.verb_weight, 4) AS verb_weight, b.verb_duration
        FROM binned b LEFT JOIN weight_classes w USING (item_id, observable)"""


def sql(query: str, *changes: tuple[str, str]) -> str:
    """The query with all views it may need in front."""
    columns = {"fit": "fit(step, low, high)"}
    views = ",\n".join(f"{columns.get(name, name)} AS ({body})" for name, body in VIEWS.items() if _needed(name, query))
    text = f"WITH {'RECURSIVE ' if 'fit(step, low, high) AS' in views else ''}{views}\n{query}"
    for old, new in changes:
        text = text.replace(old, new)
    return text


def _uses(text: str, name: str) -> bool:
    padded = f" {text} ".replace("\n", " ").replace("(", " ").replace(")", " ").replace(",", " ")
    return f" {name} " in padded


def _needed(name: str, query: str) -> bool:
    if _uses(query, name):
        return True
    later = list(VIEWS)[list(VIEWS).index(name) + 1 :]
    return any(_uses(VIEWS[v], name) and _needed(v, query) for v in later)


def add(name: str, query: str) -> None:
    ORACLES[name] = sql(query)


# --- Preparation ----------------------------------------------------------------------
add("event_log_truncate", f"""
SELECT student_id, seq, batch FROM elapsed
JOIN (VALUES ('10', {600 * SECOND}), ('20', {1200 * SECOND}), ('30', NULL)) b(batch, lim)
  ON lim IS NULL OR us <= lim * CAST(1000000 AS BIGINT)""")


def limited(query: str, limit: int | None) -> str:
    """The query with the log cut to a time limit in front of all cleaning."""
    inside = "TRUE" if limit is None else f"us <= {limit} * CAST(1000000 AS BIGINT)"
    cut = f"(SELECT * EXCLUDE (us) FROM ({VIEWS['elapsed']}) e WHERE {inside})"
    return sql(query, ("SELECT * FROM log\n        WHERE", f"SELECT * FROM {cut} l\n        WHERE"))


ORACLES["nested_attempts"] = "\nUNION ALL\n".join(
    f"""SELECT '{batch}' AS batch, * FROM ({limited(
        "SELECT student_id, item_id, attempt, round(duration, 6) AS duration, verb_chain "
        "FROM durations LEFT JOIN chains USING (student_id, item_id, attempt)", limit)})"""
    for batch, limit in (("10", 600 * SECOND), ("20", 1200 * SECOND), ("30", None))
)
add("elapsed_time", "SELECT student_id, seq, round(us / 1e6, 6) AS elapsed FROM elapsed")
add("base_clean", "SELECT student_id, seq, item_id, observable FROM clean WHERE item_id IN ('IT00','IT01','IT02','IT03')")
add("verb_groups", "SELECT student_id, seq, observable FROM grouped")
add("attempt_index", "SELECT student_id, seq, item_id, attempt FROM visited")
add("attempt_index_cut", "SELECT student_id, seq, item_id, attempt, verb_run FROM numbered")
add("verb_run_index", "SELECT student_id, seq, attempt, verb_run FROM numbered")
add("occur_minute", """
SELECT student_id, seq, (epoch_us(event_time) - min(epoch_us(event_time)) OVER (PARTITION BY student_id))
       // 86400000000 AS minute FROM clean""")

# --- Times ----------------------------------------------------------------------------
add("attempt_duration", "SELECT student_id, item_id, attempt, round(duration, 6) AS duration FROM durations")


def x_columns() -> str:
    return ", ".join(
        f"coalesce(max(duration) FILTER (item_id = '{i}' AND attempt = {a}), 0) AS x_{i}_{a}"
        for i in ITEMS
        for a in (1, 2, 3)
        if a < 3 or i in ITEMS[:2]
    )


def y_columns() -> str:
    return ", ".join(
        f"coalesce(max(CAST({m} AS DOUBLE)) FILTER (item_id = '{i}'), 0) AS y_{m}_{i}"
        for m in STATS
        for i in ITEMS
    )


# Means are quotients of exact sums, equal to the last bit; spreads and z are rounded.
Z = [
    "valid_question_attempt_percent",
    "question_attempt_mean_time",
    "question_attempt_std_time",
    "scaled_question_attempt_mean_time",
    "scaled_question_attempt_std_time",
]
add("attempt_duration_wide", f"SELECT student_id, {x_columns()} FROM durations GROUP BY student_id")
add("item_attempt_stats", """
SELECT student_id, item_id, attempt_times, attempt_mean_time, attempt_min_time FROM item_stats""")
add("item_attempt_stats_wide", f"SELECT student_id, {y_columns()} FROM item_stats GROUP BY student_id")
add("item_duration_stats", """
SELECT item_id, sum(micros) / 1e6 / count(*) AS item_mean, round(stddev_samp(duration), 6) AS item_std
FROM durations GROUP BY item_id""")
add("item_zscore", "SELECT student_id, item_id, attempt, round(z, 6) AS z FROM zscores")
add("item_zscore_fitted", """
SELECT d.student_id, d.item_id, d.attempt, round((d.duration - s.m) / nullif(s.sd, 0), 6) AS z
FROM durations d JOIN (SELECT item_id, avg(duration) AS m, stddev_samp(duration) AS sd FROM durations
                       WHERE student_id % 4 <> 0 GROUP BY item_id) s USING (item_id)
WHERE d.student_id % 4 = 0""")

ORACLES["item_zscore_merged"] = ORACLES["item_zscore_fitted"]


def z_columns(prefix: str = "") -> str:
    return ", ".join(
        f"{c} AS {prefix}{c}" if c in Z[:2] else f"round({c}, 6) AS {prefix}{c}" for c in Z
    )


add("student_time_stats", f"SELECT student_id, {z_columns()} FROM student_stats")
add("time_features", f"""
SELECT * FROM (SELECT student_id, {x_columns()} FROM durations GROUP BY student_id) x
JOIN (SELECT student_id, {y_columns()} FROM item_stats GROUP BY student_id) y USING (student_id)
JOIN (SELECT student_id, {z_columns("z_")} FROM student_stats) z USING (student_id)""")
add("verb_duration", "SELECT student_id, seq, round(verb_duration, 6) AS verb_duration FROM verb_durations")
add("duration_level", "SELECT student_id, seq, duration_level FROM levels")
add("duration_level_by_verb", """
SELECT student_id, seq,
       CASE WHEN unit IS NULL THEN 0.0 WHEN unit > 0 THEN floor(verb_duration / unit)
            WHEN verb_duration = 0 THEN 0.0 ELSE CAST('Infinity' AS DOUBLE) END AS duration_level
FROM (SELECT *, stddev_samp(verb_duration) OVER (PARTITION BY item_id, observable) / 10 AS unit
      FROM verb_durations) u""")

# --- Behaviour ------------------------------------------------------------------------
add("verb_chain", "SELECT student_id, item_id, attempt, verb_chain FROM chains")
add("chain_counts", "SELECT item_id, verb_chain, attempts FROM chain_counted")
add("top_verb_chains", "SELECT item_id, verb_chain, attempts, rank FROM top")
add("common_verb_chains", "SELECT student_id, item_id, attempt, verb_chain FROM common")
add("chain_features", "SELECT student_id, feature, value FROM chain_featured")
add("first_of_verb_run", "SELECT student_id, item_id, attempt, verb_run, seq, observable FROM firsts")
add("verb_time_tokens", "SELECT student_id, position, token FROM tokens")
#: Fillers, which have no token of their own, as one span per student.
PADDED_SPANS = """(SELECT student_id, min(position) AS start, max(position) AS "end", token
     FROM (SELECT *, CASE WHEN token = '' THEN -1 ELSE position END AS island FROM padded) p
     GROUP BY student_id, island, token)"""
add("verb_time_padded", f'SELECT student_id, start, "end", token FROM {PADDED_SPANS} s')
add("verb_time_codes", f"""
SELECT student_id, start // 1000 AS block,
       string_agg(CAST(code AS VARCHAR) || 'x' || CAST("end" - start + 1 AS VARCHAR), ' ' ORDER BY start) AS codes
FROM (SELECT *, dense_rank() OVER (ORDER BY token) - 1 AS code FROM {PADDED_SPANS} s) c GROUP BY 1, 2""")
add("minute_summary", """
SELECT student_id, minute, duration_level, verb_count, unique_verb_count,
       array_to_string(unique_verbs, ',') AS unique_verbs FROM minute_counted""")
add("minute_lists", """
SELECT student_id, minute, place // 1000 AS block,
       string_agg(observable || '/' || item_type, ',' ORDER BY place) AS verbs
FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY event_time, seq) - 1 AS place
      FROM minute_kept) p
GROUP BY 1, 2, 3""")
#: Minutes without events next to each other as one span.
MINUTE_SPANS = """(SELECT student_id, min(minute) AS start, max(minute) AS "end", duration_level, verb_count, unique_verb_count, unique_verb_chain
     FROM (SELECT *, CASE WHEN verb_count > 0 THEN -1 - minute ELSE minute - row_number() OVER (
               PARTITION BY student_id, verb_count > 0 ORDER BY minute) END AS island FROM minute_grid) g
     GROUP BY student_id, island, duration_level, verb_count, unique_verb_count, unique_verb_chain)"""
add("minute_series", f"SELECT * FROM {MINUTE_SPANS} s")
add("minute_codes", f"""
SELECT student_id, start, "end", duration_level, verb_count, unique_verb_count,
       dense_rank() OVER (ORDER BY unique_verb_chain) - 1 AS unique_verb_chain FROM {MINUTE_SPANS} s""")
add("minute_tensor", f"""
SELECT student_id, start // 1000 AS block,
       string_agg(CAST(start AS VARCHAR) || ':' || CAST("end" AS VARCHAR) || ':' || CAST(CAST(duration_level AS BIGINT) AS VARCHAR)
                  || ':' || CAST(verb_count AS VARCHAR) || ':'
                  || CAST(unique_verb_count AS VARCHAR) || ':' || unique_verb_chain, ';' ORDER BY start) AS minutes
FROM {MINUTE_SPANS} s GROUP BY 1, 2""")

# --- Series ---------------------------------------------------------------------------
add("clean_extended_info", "SELECT student_id, seq, item_id, item_type, observable FROM combined")
add("second_bins", "SELECT student_id, seq, occur_second, verb_duration FROM binned")
add("last_per_second", """
SELECT student_id, occur_second, item_id, item_type, observable, verb_duration
FROM last_rows""")
add("dense_series", """
SELECT student_id, occur_second, item_id, item_type, observable, verb_duration
FROM dense""")
add("series_arrays", """
SELECT student_id, string_agg(item_id, ',' ORDER BY occur_second) AS item_id,
       string_agg(observable, ',' ORDER BY occur_second) AS observable
FROM dense GROUP BY student_id""")
add("encoding_dims", """
SELECT feature_type, dim, CAST(floor(sqrt(dim) / 2) AS BIGINT) AS width FROM (
    SELECT 'item_id' AS feature_type, count(DISTINCT item_id) AS dim FROM dense UNION ALL
    SELECT 'item_type', count(DISTINCT item_type) FROM dense UNION ALL
    SELECT 'observable', count(DISTINCT observable) FROM dense UNION ALL
    SELECT 'verb_weight', 6) d""")
add("encoded_series", """
SELECT student_id, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY occur_second) AS item_id,
       string_agg(CAST(item_type AS VARCHAR), ' ' ORDER BY occur_second) AS item_type,
       string_agg(CAST(observable AS VARCHAR), ' ' ORDER BY occur_second) AS observable
FROM coded GROUP BY student_id""")
add("stacked_series", """
SELECT student_id, string_agg(item_id || '/' || item_type, ',' ORDER BY occur_second) AS series
FROM dense GROUP BY student_id""")

# --- Sources and back -----------------------------------------------------------------
add("log_csv", "SELECT student_id, item_id, item_type, observable, ext_info, event_time FROM log")
add("labels_csv", """
SELECT student_id, student_id % 2 = 1 AS label, row_number() OVER (ORDER BY student_id DESC) - 1 AS position
FROM (SELECT DISTINCT student_id FROM log) s""")
ORACLES["partitioned_table"] = f"""
SELECT CASE WHEN student_id % 4 <> 0 THEN 'train' ELSE 'hidden' END AS task, batch, item_id, count(*) AS attempts,
       CAST(sum(CAST(round(duration * 1000000) AS BIGINT)) AS BIGINT) AS micros
FROM ({ORACLES["nested_attempts"]}) a GROUP BY 1, 2, 3"""
add("eliminated_choices", """
SELECT item_id, regexp_extract(ext_info, '_([0-9]:.*)$', 1) AS option, count(*) AS events
FROM log WHERE observable = 'Click Choice' GROUP BY 1, 2""")
add("nested_json", """
SELECT student_id, item_id, n // 1000 AS block,
       row_number() OVER (PARTITION BY student_id, item_id, n // 1000 ORDER BY n) - 1 AS place,
       observable AS action, ext_info AS info, event_time AS "time"
FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY event_time, seq) - 1 AS n FROM forced) f""")
add("submission_file", "SELECT CAST(p AS DOUBLE) AS probability_true, count(*) AS lines FROM guesses GROUP BY 1")
add("saved_series", """
SELECT CASE WHEN student_id % 4 <> 0 THEN 'train' ELSE 'hidden' END AS task, student_id, feature, place // 1000 AS block,
       string_agg(CAST(v AS VARCHAR), ' ' ORDER BY place) AS series
FROM (SELECT student_id, 'item_id' AS feature, occur_second AS place, item_id AS v FROM coded
      UNION ALL
      SELECT s.student_id, 'verb_weight', p.position, coalesce(w.verb_weight, 0)
      FROM (SELECT DISTINCT student_id FROM weight_places) s CROSS JOIN (SELECT DISTINCT position FROM weight_places) p
      LEFT JOIN weight_places w ON w.student_id = s.student_id AND w.position = p.position) x
GROUP BY 1, 2, 3, 4""")
add("saved_dims", """
SELECT 'item_id' AS feature_type, count(DISTINCT item_id) AS dim FROM dense UNION ALL
SELECT 'item_type', count(DISTINCT item_type) FROM dense UNION ALL
SELECT 'observable', count(DISTINCT observable) FROM dense UNION ALL
SELECT 'verb_weight', 6""")

# --- Answers and scores ---------------------------------------------------------------
add("item_in_force", "SELECT student_id, seq, item_id FROM forced")
add("attempt_split", "SELECT student_id, seq, item_id, CAST(visit AS BIGINT) AS visit FROM inside")
LOG_PLACES = """(SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY event_time, seq) - 1 AS n
      FROM forced) f"""
add("student_item_logs", f"""
SELECT student_id, student_id % 2 = 1 AS label, item_id, n // 1000 AS block,
       string_agg(observable || coalesce('|' || ext_info, ''), ';' ORDER BY n) AS events
FROM {LOG_PLACES} GROUP BY student_id, item_id, n // 1000""")
add("student_item_events", f"""
SELECT student_id, item_id, n // 1000 AS block,
       row_number() OVER (PARTITION BY student_id, item_id, n // 1000 ORDER BY n) - 1 AS place,
       observable AS action, ext_info AS info
FROM {LOG_PLACES}""")
add("answer_choice", "SELECT student_id, item_id, answer FROM choices")
for name, item in (("answer_blank", "IT00"), ("answer_multi_blank", "IT01"), ("answer_composite", "IT02")):
    add(name, f"SELECT student_id, item_id, array_to_string(slots, '|') AS answer FROM blank_texts WHERE item_id = '{item}'")
add("answer_match", """
SELECT student_id, item_id, array_to_string(list_transform(slots, lambda s: coalesce(s, '-')), '|') AS answer
FROM matches""")


def by_item(value: str) -> str:
    return ", ".join(f"max({value}) FILTER (item_id = '{i}') AS {i}" for i in ITEMS)


TEXT = """(CASE WHEN status <> 'answered' THEN status WHEN item_id = 'IT00' THEN slots[1]
     ELSE '[' || array_to_string(list_transform(slots, lambda s: coalesce('"' || s || '"', 'null')), ',') || ']' END)"""
SCORE_TEXT = "coalesce(CAST(score AS VARCHAR), status)"
add("response_matrix", f"""
SELECT student_id, student_id % 2 = 1 AS label, {by_item(TEXT)} FROM scored GROUP BY student_id""")
add("score_long", "SELECT student_id, item_id, status, score FROM scored")
add("score_matrix", f"SELECT student_id, student_id % 2 = 1 AS label, {by_item(SCORE_TEXT)} FROM scored GROUP BY student_id")


def batch_scores() -> str:
    """Each batch alone: the log cut to its time limit, every student kept on the roster."""
    parts = []
    for batch, limit in (("10", 600 * SECOND), ("20", 1200 * SECOND), ("30", 10**9)):
        one = sql(
            f"""SELECT CASE WHEN student_id % 4 <> 0 THEN 'train' ELSE 'hidden' END AS task, '{batch}' AS batch,
                student_id, student_id % 2 = 1 AS label, {by_item(SCORE_TEXT)} FROM scored GROUP BY student_id"""
        )
        full = one.replace("FROM log\n        WINDOW", f"FROM elapsed WHERE us <= {limit * 10**6}\n        WINDOW")
        full = full.replace("students AS (", f"elapsed AS ({VIEWS['elapsed']}),\nstudents AS (")
        parts.append(f"SELECT * FROM ({full})")
    return "\nUNION ALL\n".join(parts)


ORACLES["score_all_batches"] = batch_scores()
add("item_right_share", """
SELECT item_id, count(*) AS answered, round(avg(score), 6) AS right_share
FROM choice_scored WHERE answer IS NOT NULL GROUP BY item_id""")
add("conditional_option_share", """
SELECT item_id, answer AS option, count(*) AS students, max(score) AS is_right,
       CAST(sum(count(*)) OVER (PARTITION BY item_id) AS BIGINT) AS answered,
       round(count(*) / sum(count(*)) OVER (PARTITION BY item_id), 6) AS share
FROM choice_scored WHERE answer IS NOT NULL AND student_id IN (SELECT student_id FROM passed)
GROUP BY item_id, answer""")

#: Slots of an item of the mixed key, and its answer as one text.
N_SLOTS = "(CASE item_id WHEN 'IT00' THEN 1 WHEN 'IT01' THEN 5 WHEN 'IT02' THEN 3 ELSE 4 END)"
MIXED = f"""(SELECT *, CAST(score = {N_SLOTS} AS BIGINT) AS is_right,
    array_to_string(list_transform(slots, lambda s: coalesce(s, '-')), '|') AS answer FROM scored WHERE slots IS NOT NULL)"""
add("item_right_share_mixed", f"""
SELECT item_id, count(*) AS answered, round(avg(is_right), 6) AS right_share FROM {MIXED} m GROUP BY item_id""")
#: Choices at three items, and the match item with its four slots.
CHOICES_AND_MATCH = f"""(SELECT student_id, item_id, answer, score AS is_right FROM choice_scored
    WHERE item_id <> 'IT03' AND answer IS NOT NULL
    UNION ALL SELECT student_id, item_id, answer, is_right FROM {MIXED} x WHERE item_id = 'IT03')"""
add("conditional_option_share_mixed", f"""
SELECT item_id, answer AS option, count(*) AS students, max(is_right) AS is_right,
       CAST(sum(count(*)) OVER (PARTITION BY item_id) AS BIGINT) AS answered,
       round(count(*) / sum(count(*)) OVER (PARTITION BY item_id), 6) AS share
FROM {CHOICES_AND_MATCH} m WHERE student_id IN (
    SELECT student_id FROM {CHOICES_AND_MATCH} r WHERE is_right = 1 AND item_id IN (
        SELECT item_id FROM {CHOICES_AND_MATCH} e GROUP BY item_id ORDER BY avg(is_right) DESC, item_id LIMIT 2)
    GROUP BY student_id HAVING count(*) = 2)
GROUP BY item_id, answer""")

# --- Encoders -------------------------------------------------------------------------
for name in ("label_encode", "label_encode_cut"):
    add(name, "SELECT observable, row_number() OVER (ORDER BY observable) - 1 AS code FROM (SELECT DISTINCT observable FROM combined) v")
add("one_hot", """
SELECT r.student_id, string_agg(CASE WHEN r.answer = c.answer THEN '1' ELSE '0' END, '' ORDER BY c.item_id, c.answer) AS features
FROM choice_text r
JOIN (SELECT DISTINCT item_id, answer FROM choice_text
      WHERE student_id % 4 <> 0 AND item_id IN ('IT00', 'IT01')) c USING (item_id)
GROUP BY r.student_id""")
add("response_features", """
SELECT r.student_id, string_agg(CASE WHEN r.answer = c.answer THEN '1' ELSE '0' END, '' ORDER BY c.item_id, c.answer) AS features
FROM choice_text r
JOIN (SELECT DISTINCT item_id, answer FROM choice_text WHERE item_id <> 'IT00') c USING (item_id)
GROUP BY r.student_id""")
add("weight_bins", "SELECT item_id, observable, verb_weight FROM rate_bins")
add("weight_rows", """
SELECT b.student_id, row_number() OVER (PARTITION BY b.student_id ORDER BY b.event_time, b.seq) - 1 AS position,
       coalesce(w.verb_weight, 4) AS verb_weight, b.verb_duration
FROM binned b LEFT JOIN (SELECT * FROM rate_bins WHERE item_id <> 'IT03') w USING (item_id, observable)""")

add("verb_weight_map", "SELECT item_id, observable, verb_weight FROM weight_classes")
TRAIN_EVENTS = "WHERE student_id % 4 <> 0 AND item_id IS NOT NULL AND observable IS NOT NULL"
ORACLES["verb_weights_by_fold"] = "\nUNION ALL\n".join(
    "SELECT * FROM (" + sql(
        f"SELECT {fold} AS fold, item_id, observable, round(verb_weight, 5) AS verb_weight FROM weighed",
        (TRAIN_EVENTS, f"{TRAIN_EVENTS} AND (student_id // 2) % 3 <> {fold}"),
    ) + ")"
    for fold in range(3)
)
add("weight_sequences", """
SELECT student_id, position AS start, position AS "end", verb_weight, verb_duration FROM weight_places
UNION ALL
SELECT student_id, max(position) + 1, (SELECT max(position) FROM weight_places), 0, 0.0 FROM weight_places
GROUP BY student_id HAVING max(position) < (SELECT max(position) FROM weight_places)""")

# --- Training and metrics -------------------------------------------------------------
add("labelled_events", """
SELECT observable, CASE WHEN student_id % 4 <> 0 THEN student_id % 2 = 1 END AS label, count(*) AS events
FROM log GROUP BY 1, 2""")


def split_features(query: str) -> str:
    """The views twice, once per set of students, as each set is featured alone."""
    hidden = sql(query).replace("FROM log", "FROM log WHERE student_id % 4 = 0", 1)
    train = sql(query).replace("FROM log", "FROM log WHERE student_id % 4 <> 0", 1)
    return f"WITH train AS ({train}), hidden AS ({hidden})"


CHAIN_SETS = split_features("SELECT student_id, feature, value FROM chain_featured").replace(
    "SELECT * FROM log WHERE student_id % 4 = 0\n        WHERE", "SELECT * FROM log\n        WHERE student_id % 4 = 0 AND"
).replace(
    "SELECT * FROM log WHERE student_id % 4 <> 0\n        WHERE", "SELECT * FROM log\n        WHERE student_id % 4 <> 0 AND"
)
ORACLES["common_features"] = CHAIN_SETS + """
SELECT * FROM train WHERE feature IN (SELECT feature FROM hidden)
UNION ALL SELECT * FROM hidden WHERE feature IN (SELECT feature FROM train)"""
TRAIN_ONLY = ORACLES["time_features"].replace(
    "SELECT * FROM log\n        WHERE", "SELECT * FROM log\n        WHERE student_id % 4 <> 0 AND"
)
ORACLES["train_features"] = (
    "SELECT student_id % 2 = 1 AS label, t.* FROM (" + TRAIN_ONLY + ") t"
)
ORACLES["sparse_features"] = f"""
WITH wide AS ({ORACLES["train_features"]}),
long AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR feature IN (COLUMNS(* EXCLUDE (student_id, label))))),
numbers AS (SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS "index" FROM (SELECT DISTINCT feature FROM long) d)
SELECT student_id, label, "index", feature, value FROM long JOIN numbers USING (feature) WHERE value <> 0"""
add("submission", """
SELECT s.student_id AS ord, CAST(coalesce(CASE WHEN s.student_id % 4 <> 1 THEN CAST(g.p AS DOUBLE) END, 0.0)
       AS VARCHAR) || ',' AS value
FROM students s LEFT JOIN guesses g USING (student_id)""")
add("stratified_folds", """
SELECT student_id, student_id % 2 = 1 AS label,
       (row_number() OVER (PARTITION BY student_id % 2 ORDER BY student_id) - 1) % 3 AS fold FROM students""")
add("hash_split", """
SELECT student_id, CAST('0x' || substr(md5('8:' || CAST(student_id AS VARCHAR)), 1, 8) AS BIGINT) < 858993459 AS validation
FROM students""")
add("metrics_auc", "SELECT fold, round(auc, 6) AS auc FROM fold_auc")
COUNTS = """SELECT {by} count(*) AS n,
       count(*) FILTER (truth = 0 AND p <= 0.5) AS tn, count(*) FILTER (truth = 0 AND p > 0.5) AS fp,
       count(*) FILTER (truth = 1 AND p <= 0.5) AS fn, count(*) FILTER (truth = 1 AND p > 0.5) AS tp
    FROM guesses {where} {group}"""
KAPPA = """(((tn + tp) / n - ((tn + fp) * (tn + fn) + (fn + tp) * (fp + tp)) / (n * n))
        / (1 - ((tn + fp) * (tn + fn) + (fn + tp) * (fp + tp)) / (n * n)))"""
FOLD_COUNTS = COUNTS.format(by="fold,", where="", group="GROUP BY fold")
add("metrics_kappa", f"""
SELECT fold, tn, fp, fn, tp, round((tn + tp) / n, 6) AS accuracy, round({KAPPA}, 6) AS kappa
FROM ({FOLD_COUNTS}) c""")
add("metrics_adjusted", f"""
SELECT round(a, 6) AS adj_auc, round(k, 6) AS adj_kappa, round(a + k, 6) AS adj_score
FROM (SELECT greatest(2 * ((SELECT avg(auc) FROM fold_auc) - 0.5), 0.0) AS a, greatest({KAPPA}, 0.0) AS k
      FROM ({COUNTS.format(by="", where="", group="")}) c) s""")


def prefix_scores(trees: int) -> str:
    """`metrics_adjusted` of the mean vote of the first trees."""
    votes = f"""SELECT student_id, truth, fold, sum(((student_id * 31 + t * t * 17 + t * 7) % 97 + truth * 31) / 128.0::DOUBLE) / {trees} AS p
        FROM guesses, unnest(range(0, {trees})) u(t) GROUP BY student_id, truth, fold"""
    counts = COUNTS.format(by="", where="", group="").replace("guesses", "averaged")
    auc = VIEWS["fold_auc"].replace("guesses", "averaged")
    return sql(f"""SELECT CAST({trees} AS BIGINT) AS trees, round(a, 6) AS adj_auc, round(k, 6) AS adj_kappa, round(a + k, 6) AS adj_score
FROM (WITH averaged AS ({votes}) SELECT greatest(2 * ((SELECT avg(auc) FROM ({auc}) f) - 0.5), 0.0) AS a, greatest({KAPPA}, 0.0) AS k
      FROM ({counts}) c) s""")


ORACLES["forest_prefix_votes"] = "\nUNION ALL\n".join(f"SELECT * FROM ({prefix_scores(n)})" for n in (5, 15, 30))
ORACLES["best_grid_setting"] = f"""
SELECT trees, CAST(0.3 AS DOUBLE) AS feature_fraction FROM ({ORACLES["forest_prefix_votes"]}) v ORDER BY adj_score DESC, trees LIMIT 1"""
add("metrics_accuracy", """
SELECT count(*) AS students, count(*) FILTER ((p > 0.5) = (truth = 1)) AS right,
       round(avg(CASE WHEN (p > 0.5) = (truth = 1) THEN 1 ELSE 0 END), 6) AS accuracy FROM guesses""")
add("metrics_by_fold", f"""
SELECT fold, round(loss, 6) AS loss, round((tn + tp) / n, 6) AS accuracy, round(auc, 6) AS auc,
       round({KAPPA}, 6) AS kappa
FROM ({COUNTS.format(by="fold,", where="", group="GROUP BY fold")}) c
JOIN (SELECT fold, avg(-CASE WHEN truth = 1 THEN ln(clipped) ELSE ln(1 - clipped) END) AS loss
      FROM (SELECT *, greatest(least(CAST(p AS DOUBLE), 1 - 1e-15), 1e-15) AS clipped FROM guesses) GROUP BY fold) l USING (fold)
JOIN (SELECT a.fold, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc
      FROM guesses a JOIN guesses b ON a.fold = b.fold AND a.truth = 1 AND b.truth = 0
      GROUP BY a.fold) r USING (fold)""")
add("describe", """
SELECT 'duration' AS "column", count(duration) AS count, round(avg(duration), 4) AS mean,
       round(stddev_samp(duration), 4) AS std, round(min(duration), 4) AS min,
       round(quantile_cont(duration, 0.25), 4) AS q25, round(quantile_cont(duration, 0.5), 4) AS q50,
       round(quantile_cont(duration, 0.75), 4) AS q75, round(max(duration), 4) AS max
FROM durations""")
