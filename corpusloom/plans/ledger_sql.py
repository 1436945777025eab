"""The ledger queries in SQL for another engine, written apart from the operators; only comparisons use it."""

from __future__ import annotations

from . import oracle as O
from ..queries_similarity import _LONG, _SH
from ..queries_similarity import ORACLE_SQL as _OTHER

M = f"""m AS (SELECT d.doc_id AS key, concat('dir', CAST(d.doc_id % 7 AS STRING), '/sub', CAST(d.doc_id % 3 AS STRING), '/f', CAST(d.doc_id AS STRING), '.md') AS path,
  concat('dir', CAST(d.doc_id % 7 AS STRING)) AS folder, d.lang, d.source AS type, {O.n_words("coalesce(d.text, '')")} AS words,
  CASE WHEN d.doc_id % 11 = 0 THEN 'forgotten' WHEN d.doc_id % 13 = 0 THEN 'unreachable' WHEN d.doc_id % 17 = 0 THEN 'superseded' ELSE 'active' END AS status,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'own' WHEN l.quality = 0 THEN 'other' ELSE 'undecided' END AS ownership,
  d.doc_id % 19 = 0 AS holdout, d.doc_id % 29 <> 0 AS cached, 2015 + d.doc_id % 10 AS year
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
F = """f AS (SELECT CASE WHEN key % 23 = 0 THEN key + 1000000 ELSE key END AS key, CASE WHEN key % 6 = 0 THEN concat('moved/', path) ELSE path END AS path, words, lang, type, year FROM m WHERE key % 5 <> 0)"""
RULES = """rules AS (SELECT * FROM (VALUES ('.', 'sam', 'own', 0), ('dir1', 'sam', 'other', 1), ('dir1/sub1', 'sam', 'own', 2), ('dir2', 'kim', 'own', 1), ('dir2', 'kim', 'other', 1), ('dir3/sub0', 'kim', 'own', 2)) AS t(rule_path, profile, ownership, depth))"""
OWN = "own AS (SELECT * FROM m WHERE ownership = 'own' AND status IN ('active', 'unreachable') AND NOT holdout AND cached)"
UNDER = "(rule_path = '.' OR path = rule_path OR substr(path, 1, length(rule_path) + 1) = concat(rule_path, '/'))"
PROFILES = "profiles AS (SELECT * FROM (VALUES ('base', NULL, 'self'), ('sam', 'base', 'self'), ('acme', 'sam', 'given'), ('kim', 'base', 'given'), ('loop1', 'loop2', 'self'), ('loop2', 'loop1', 'self')) AS t(profile, parent, consent))"
CHAIN = f"""{PROFILES}, chain AS (SELECT profile AS start, profile, parent, consent, 0 AS depth, concat('/', profile, '/') AS seen FROM profiles
  UNION ALL SELECT c.start, p.profile, p.parent, p.consent, c.depth + 1, concat(c.seen, p.profile, '/') FROM chain c JOIN profiles p ON p.profile = c.parent WHERE c.seen NOT LIKE concat('%/', p.profile, '/%') AND c.depth < 20)"""

_FLAGS = _OTHER["o138_metric_flags"]
_TEXT = "coalesce(text, '')"
_QUOTES = "SELECT d.doc_id AS key, b.item_id AS item FROM documents d JOIN benchmark b ON contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')))"

SQL: dict[str, str] = {
    "o010_transcript_paragraphs": "WITH c AS (SELECT user_id AS session, event_type, ts, CASE WHEN lag(event_type) OVER w = event_type AND lag(ts) OVER w >= ts - INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS para FROM c) SELECT session, para, min(event_type) AS speaker, count(*) AS cues, min(event_id) AS first FROM g GROUP BY session, para",
    "o014_corpus_texts": f"WITH {M} SELECT m.key, d.n_chars, m.status FROM m JOIN documents d ON d.doc_id = m.key WHERE m.cached AND m.status <> 'forgotten'",
    "o016_connector_add": f"WITH {M}, {F} SELECT f.key, f.path, f.words, 'web' AS origin, CASE WHEN m.key IS NOT NULL THEN 'refused: known' WHEN f.words < 150 THEN 'refused: too short' ELSE 'added' END AS result FROM f LEFT JOIN m ON m.key = f.key",
    "o017_interview_add": f"WITH {M}, f AS (SELECT conv_id * 2 AS key, 'interview/' || conv_id || '-' || turn AS path, {O.n_words(_TEXT)} AS words FROM conversations WHERE role = 'user') SELECT f.key, f.path, f.words, 'interview' AS origin, CASE WHEN m.key IS NOT NULL THEN 'refused: known' WHEN f.words < 60 THEN 'refused: too short' ELSE 'added' END AS result FROM f LEFT JOIN m ON m.key = f.key",
    "o018_bridge_plan": f"WITH {M}, {F}, todo AS (SELECT f.path, f.words FROM f LEFT JOIN m ON m.path = f.path AND m.words = f.words AND m.key = f.key WHERE m.key IS NULL) SELECT path, CAST(floor((row_number() OVER (ORDER BY path) - 1) / 50) AS BIGINT) AS batch FROM todo",
    "o019_bridge_diff": f"WITH {M}, {F} SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'delete' WHEN m.path IS NULL OR m.key <> f.key THEN 'write' ELSE 'keep' END AS action FROM f FULL OUTER JOIN m ON m.path = f.path",
    "o046_short_joined": f"WITH mails AS (SELECT role AS folder, conv_id, {O.n_words(_TEXT)} AS words, DATE '2024-01-01' + conv_id::INT AS day FROM conversations WHERE {O.n_words(_TEXT)} < 150), threads AS (SELECT folder, conv_id, count(*) AS members, sum(words) AS words, max(day) AS last FROM mails GROUP BY folder, conv_id HAVING count(*) >= 2 AND sum(words) >= 150), rest AS (SELECT m.* FROM mails m WHERE NOT EXISTS (SELECT 1 FROM threads t WHERE t.folder = m.folder AND t.conv_id = m.conv_id)) SELECT folder, 'thread-' || substr(sha1(conv_id::VARCHAR), 1, 8) AS gid, members, words, last::DATE::VARCHAR AS last FROM threads UNION ALL SELECT folder, 'week-' || date_trunc('week', day)::DATE, count(*), sum(words), max(day)::DATE::VARCHAR FROM rest GROUP BY folder, date_trunc('week', day) HAVING sum(words) >= 150",
    "o048_facet_precedence": f"WITH {M} SELECT key, coalesce(CASE WHEN key % 9 = 0 THEN 'note' END, nullif(type, 'src3'), CASE WHEN key % 2 = 0 THEN 'essay' END, 'unknown') AS type FROM m",
    "o049_document_date": "SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN make_date(2023, CAST(1 + event_id % 9 AS INT), 17) ELSE CAST(ts AS DATE) END AS VARCHAR) AS day FROM events",
    "o057_under_path": f"WITH {M}, {RULES} SELECT m.key, rule_path, profile FROM m JOIN rules ON {UNDER}",
    "o058_scope": f"WITH {M} SELECT key FROM m WHERE starts_with(path, 'dir1/') OR (starts_with(path, 'dir2/sub0/') AND NOT contains(substr(path, 11), '/')) OR lang = 'es'",
    "o059_excludes": f"WITH {M} SELECT key FROM m WHERE NOT (contains(path, '/sub2/') OR (folder = 'dir4' AND path LIKE '%7.md') OR regexp_matches(path, '/f[^/]1[.]md$'))",
    "o060_own_texts": f"WITH {M}, {OWN} SELECT key, lang, type, words FROM own",
    "o061_supported_languages": "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('ja', 'zh', 'th', 'lo', 'km', 'my', 'bo')",
    "o062_long_enough": f"WITH {M} SELECT key, words FROM m WHERE words >= 150",
    "o063_rulings_in_slot": f"WITH {M}, r AS (SELECT * FROM (VALUES ('r1', NULL, NULL), ('r2', 'en.src1', NULL), ('r3', NULL, 'de'), ('r4', 'fr.src2', 'fr'), ('r5', 'fr.src2', 'de')) AS t(id, slot, lang)), s AS (SELECT DISTINCT concat(lang, '.', type) AS slot, lang FROM m) SELECT s.slot, r.id FROM s JOIN r ON (r.slot IS NULL OR r.slot = s.slot) AND (r.lang IS NULL OR r.lang = s.lang)",
    "o064_applicable_metrics": "WITH need AS (SELECT * FROM (VALUES ('hedges_per_1k', ['en', 'de']), ('conjunction_opener_share', ['en']), ('contractions_per_1k', ['en'])) AS t(metric, have)) SELECT metric, lang, list_contains(have, lang) AS applies FROM need CROSS JOIN (SELECT DISTINCT lang FROM documents) d",
    "o065_applicable_signs": "SELECT * FROM (VALUES ('s1', 'deferred'), ('s2', 'applies'), ('s3', 'allowed'), ('s4', 'allowed'), ('s5', 'applies')) AS t(id, state)",
    "o066_mirror_slots": f"WITH {M}, {OWN}, e AS (SELECT lang, type, list_sort(list(key)) AS ks FROM own GROUP BY ALL), p AS (SELECT lang, list_sort(list(key)) AS ks FROM own GROUP BY ALL) SELECT p.lang, count(e.type) AS mirrors FROM p LEFT JOIN e ON e.lang = p.lang AND e.ks = p.ks GROUP BY p.lang",
    "o067_classify_known": f"WITH {M}, {F} SELECT f.key, f.path, CASE WHEN m.key IS NULL THEN 'unknown' WHEN m.status = 'forgotten' THEN 'forgotten' WHEN m.holdout THEN 'holdout' WHEN m.status = 'superseded' THEN 'reverted' WHEN m.path = f.path THEN 'unchanged' ELSE 'renamed' END AS result FROM f LEFT JOIN m ON m.key = f.key",
    "o068_changed_paths": f"WITH {M}, {F} SELECT f.key, f.path, m.key AS supersedes FROM f JOIN m ON lower(m.path) = lower(f.path) AND m.key <> f.key AND m.status IN ('active', 'unreachable')",
    "o069_most_specific_rule": f"WITH {M}, {RULES}, hit AS (SELECT m.key, r.profile, r.ownership, r.depth, max(r.depth) OVER (PARTITION BY m.key, r.profile) AS top FROM m JOIN rules r ON {UNDER}) SELECT key, profile, min(ownership) AS ownership, count(DISTINCT ownership) > 1 AS asks FROM hit WHERE depth = top GROUP BY key, profile",
    "o070_unreachable": f"WITH {M}, {F} SELECT m.key, m.path FROM m LEFT JOIN f ON f.key = m.key LEFT JOIN f g ON g.path = m.path WHERE m.status = 'active' AND f.key IS NULL AND g.key IS NULL",
    "o073_inheritance": f"WITH RECURSIVE {CHAIN} SELECT start, profile, depth FROM chain",
    "o074_slot_resolution": f"WITH RECURSIVE {CHAIN}, slots AS (SELECT * FROM (VALUES ('base', 'en._'), ('sam', 'en.src1'), ('base', 'de.src2')) AS t(profile, slot)), ask AS (SELECT * FROM (VALUES ('acme', 'en.src1', 0), ('acme', 'en._', 1), ('kim', 'en.src1', 0), ('kim', 'en._', 1)) AS t(start, slot, general)), hit AS (SELECT a.start, s.profile, s.slot, row_number() OVER (PARTITION BY a.start ORDER BY c.depth, a.general) AS rn FROM ask a JOIN chain c ON c.start = a.start JOIN slots s ON s.profile = c.profile AND s.slot = a.slot) SELECT start, profile, slot FROM hit WHERE rn = 1",
    "o075_override_merge": f"WITH RECURSIVE {CHAIN}, r AS (SELECT * FROM (VALUES ('base', 'b1', NULL, 'use tea'), ('sam', 's1', 'b1', 'use coffee'), ('acme', 'a1', NULL, 'Use Tea'), ('base', 'b2', NULL, 'no jargon')) AS t(profile, id, overrides, text)), all_r AS (SELECT c.start, c.depth, r.* FROM chain c JOIN r ON r.profile = c.profile), gone AS (SELECT DISTINCT start, overrides AS id FROM all_r WHERE overrides IS NOT NULL), kept AS (SELECT a.*, row_number() OVER (PARTITION BY a.start, lower(a.text) ORDER BY a.depth, a.id) AS rn FROM all_r a LEFT JOIN gone g ON g.start = a.start AND g.id = a.id WHERE g.id IS NULL) SELECT start, id, text FROM kept WHERE rn = 1",
    "o078_quote_found": _QUOTES,
    "o079_rejected_lessons": "SELECT item_id AS id FROM benchmark WHERE item_id % 3 <> 0",
    "o099_status": f"WITH {M} SELECT status, count(*) AS texts, sum(CASE WHEN holdout THEN 1 ELSE 0 END) AS holdouts, sum(CASE WHEN ownership = 'own' AND status = 'active' THEN 1 ELSE 0 END) AS own_active, sum(words) AS words FROM m GROUP BY status",
    "o100_inventory_summary": f"WITH {M}, {F}, r AS (SELECT CASE WHEN m.key IS NULL THEN 'unknown' WHEN m.status = 'forgotten' THEN 'forgotten' WHEN m.holdout THEN 'holdout' WHEN m.status = 'superseded' THEN 'reverted' WHEN m.path = f.path THEN 'unchanged' ELSE 'renamed' END AS result FROM f LEFT JOIN m ON m.key = f.key) SELECT result, count(*) AS n FROM r GROUP BY result",
    "o102_primary_metrics": f"WITH f AS ({_FLAGS}), g AS (SELECT metric, count(*) FILTER (flag <> 'ok') AS flagged FROM f GROUP BY metric) SELECT metric, flagged, row_number() OVER (ORDER BY flagged DESC, metric) AS rank FROM g WHERE flagged > 0 ORDER BY rank LIMIT 5",
    "o103_edit_rollup": "SELECT event_type AS kind, count(DISTINCT user_id) AS pairs, count(DISTINCT user_id) < 2 AS seen_once FROM events WHERE value > 100 OR event_type = 'click' GROUP BY event_type",
    "o104_evidence_share": "SELECT source AS type, count(*) FILTER (contains(text, '!')) AS seen, count(*) AS of_texts, count(*) FILTER (contains(text, '!')) >= 2 AND 2 * count(*) FILTER (contains(text, '!')) >= count(*) AS is_default FROM documents GROUP BY source",
    "o105_language_majority": f"WITH {M}, g AS (SELECT folder, lang, sum(words) AS words, min(key) AS seen FROM m GROUP BY folder, lang), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY words DESC, seen) AS rn FROM g) SELECT folder, lang, words FROM r WHERE rn = 1",
    "o109_rank_agreement": "WITH arm AS (SELECT d.source AS type, avg(length(d.text)) AS a, avg(l.quality) AS b FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source) SELECT round(avg(CASE WHEN (x.a < y.a) = (x.b < y.b) THEN 1e0 ELSE 0e0 END), 6) AS agreement, count(*) AS pairs FROM arm x JOIN arm y ON x.type < y.type",
    "o110_familiarity_bins": "WITH a AS (SELECT least(floor((length(text) - length(replace(text, 'e', ''))) * 400 / length(text) / 20), 4)::BIGINT AS bin, quality = 1 AS won FROM documents JOIN labels USING (doc_id) WHERE length(text) > 0) SELECT bin, count(*) AS n, round(avg(CASE WHEN won THEN 1e0 ELSE 0e0 END), 6) AS win_rate FROM a GROUP BY bin",
    "o111_newest_in_group": f"WITH RECURSIVE {M}, {_SH}, c AS (SELECT a AS key, min(b) AS comp FROM reach GROUP BY a), r AS (SELECT m.key, row_number() OVER (PARTITION BY c.comp ORDER BY year DESC, path) AS rn FROM m JOIN c USING (key)) SELECT key, CASE WHEN rn = 1 THEN 'kept' ELSE 'skipped: near-duplicate' END AS result FROM r",
    "o120_even_spread": f"WITH {M}, {OWN}, r AS (SELECT key, lang, row_number() OVER (PARTITION BY lang ORDER BY year, key) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM own) SELECT key, lang FROM r WHERE n <= 10 OR floor(i * 10.0 / n) > floor((i - 1) * 10.0 / n)",
    "o121_capped_sample": f"WITH {M}, {OWN}, r AS (SELECT key, lang, sum(words) OVER (PARTITION BY lang ORDER BY year, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM own) SELECT key, lang, upto FROM r WHERE upto <= 20000",
    "o122_seeded_sample": f"WITH {M}, r AS (SELECT key, type, row_number() OVER (PARTITION BY type ORDER BY md5(concat('seed/', CAST(key AS STRING))), key) AS rn FROM m) SELECT key, type, rn FROM r WHERE rn <= 8",
    "o123_one_per_text": f"WITH {M}, r AS (SELECT key, type, row_number() OVER (PARTITION BY type ORDER BY key) AS rn FROM m) SELECT key, type, rn FROM r ORDER BY rn, type LIMIT 25",
    "o124_next_ids": f"WITH {M}, used AS (SELECT max(key) AS top FROM m WHERE ownership = 'own') SELECT m.key, used.top + row_number() OVER (ORDER BY m.key) AS id FROM m CROSS JOIN used WHERE m.ownership = 'other'",
    "o125_snapshots_to_prune": f"WITH {M}, r AS (SELECT key, folder, row_number() OVER (PARTITION BY folder ORDER BY year DESC, key DESC) AS rn FROM m) SELECT key, folder FROM r WHERE rn > 5",
    "o128_superseded": f"WITH {M}, {F} SELECT key FROM m WHERE status = 'active' EXCEPT SELECT key FROM f",
    "o129_write_diff": f"WITH {M}, {F} SELECT path, key FROM f EXCEPT ALL SELECT path, key FROM m",
    "o130_common_facets": f"WITH {M} SELECT type FROM m GROUP BY type HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM m)",
    "o131_sign_union": "WITH own AS (SELECT * FROM (VALUES ('a', 'en'), ('b', 'en')) AS t(id, lang)), universal AS (SELECT * FROM (VALUES ('b', 'any'), ('c', 'any')) AS t(id, lang)) SELECT id, lang FROM own UNION ALL SELECT u.id, u.lang FROM universal u LEFT JOIN own o ON o.id = u.id WHERE o.id IS NULL",
    "o139_two_references": f"WITH {M}, a AS (SELECT lang, avg(words) AS x FROM m GROUP BY lang), b AS (SELECT type, avg(words) AS y FROM m GROUP BY type) SELECT key, (words > 1.5 * x OR words < 0.5 * x) AND (words > 1.8 * y OR words < 0.4 * y) AS flagged FROM m JOIN a USING (lang) JOIN b USING (type)",
    "o140_fail_counts": "SELECT n, least(n, greatest(2, ceil(28 * n / 100e0)))::BIGINT AS fails_from FROM (SELECT unnest(range(1, 29)) AS n)",
    "o150_language_guard": f"WITH {M} SELECT key, words >= 20 AND key % 8 = 0 AND lang <> 'en' AS mismatch FROM m",
    "o151_inventory": f"""WITH RECURSIVE {M}, {F}, documents_by_new_key AS (SELECT CASE WHEN doc_id % 23 = 0 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, text FROM documents), known AS (SELECT f.*, m.status, m.holdout, m.path AS old_path, m.key IS NOT NULL AS in_ledger FROM f LEFT JOIN m ON m.key = f.key),
  olds AS (SELECT DISTINCT k.key FROM known k JOIN m ON lower(m.path) = lower(k.path) AND m.key <> k.key AND m.status IN ('active', 'unreachable')),
  rated AS (SELECT k.*, CASE WHEN k.lang IN ('ja', 'zh', 'th', 'lo', 'km', 'my', 'bo') THEN 'skipped: language not supported' WHEN in_ledger AND status = 'forgotten' THEN 'forgotten' WHEN in_ledger AND holdout THEN 'holdout' WHEN in_ledger AND status = 'superseded' THEN 'reverted'
    WHEN in_ledger AND k.path = old_path THEN 'unchanged' WHEN in_ledger THEN 'renamed' WHEN words < 150 THEN 'skipped: too short' WHEN o.key IS NOT NULL THEN 'changed' ELSE 'new' END AS result FROM known k LEFT JOIN olds o ON o.key = k.key),
  fresh AS (SELECT * FROM documents_by_new_key WHERE doc_id IN (SELECT key FROM rated WHERE result = 'new')), {_SH.replace('documents', 'fresh')},
  c AS (SELECT a AS key, min(b) AS comp FROM reach GROUP BY a), ranked AS (SELECT r.key, row_number() OVER (PARTITION BY c.comp ORDER BY year DESC, path) AS rn FROM rated r JOIN c USING (key))
  SELECT r.key, path, words, lang, type, CASE WHEN result = 'new' AND rn > 1 THEN 'skipped: near-duplicate' ELSE result END AS result FROM rated r LEFT JOIN ranked USING (key)""",
    "o152_ownership_decisions": f"WITH {M}, {RULES}, hit AS (SELECT m.key, r.profile, r.ownership, r.depth, max(r.depth) OVER (PARTITION BY m.key, r.profile) AS top FROM m JOIN rules r ON {UNDER}), best AS (SELECT key, profile, min(ownership) AS ownership, count(DISTINCT ownership) AS n FROM hit WHERE depth = top GROUP BY key, profile) SELECT m.key, b.profile, CASE WHEN m.ownership <> 'undecided' THEN m.ownership WHEN b.n = 1 THEN b.ownership ELSE 'question' END AS decision FROM m JOIN best b ON b.key = m.key",
    "o153_manifest_patch": f"WITH {M}, patch AS (SELECT key, 'superseded' AS status, false AS removed FROM m WHERE key % 10 = 1 UNION ALL SELECT key, NULL, true FROM m WHERE key % 10 = 2 UNION ALL SELECT key + 5000000, 'active', false FROM m WHERE key % 10 = 3) SELECT coalesce(p.key, m.key) AS key, coalesce(p.status, m.status) AS status FROM m FULL OUTER JOIN patch p ON p.key = m.key WHERE NOT coalesce(p.removed, false)",
    "o155_decision_cascade": "WITH RECURSIVE f AS (SELECT doc_id AS id FROM documents WHERE doc_id % 13 = 5 UNION SELECT d.doc_id FROM documents d JOIN f ON d.doc_id > 1 AND d.doc_id // 2 = f.id) SELECT DISTINCT id FROM f",
    "o156_affected_slots": f"WITH {M}, touched AS (SELECT * FROM m WHERE key % 40 = 0) SELECT DISTINCT concat(lang, '.', type) AS slot FROM touched UNION SELECT DISTINCT concat(lang, '._') FROM touched",
    "o157_rederived_slots": f"WITH {M}, hit AS (SELECT DISTINCT lang, type FROM m WHERE key % 3 = 0 AND ownership = 'other'), s AS (SELECT m.*, h.lang IS NOT NULL AS again FROM m LEFT JOIN hit h USING (lang, type)) SELECT concat(lang, '.', type) AS slot, sum(words) AS words, count(*) AS texts FROM s WHERE NOT again OR ownership <> 'other' GROUP BY lang, type",
    "o159_forgotten": f"WITH {M} SELECT key, CASE WHEN folder = 'dir3' THEN 'forgotten' ELSE status END AS status FROM m",
    "o160_holdouts": f"WITH {M}, {OWN}, r AS (SELECT key, type, row_number() OVER (PARTITION BY type ORDER BY md5(concat('holdout/', CAST(key AS STRING)))) AS rn FROM own) SELECT o.key, r.rn IS NOT NULL AND r.rn <= 2 AS holdout FROM own o JOIN r ON r.key = o.key",
    "o161_starter_rules": "SELECT doc_id AS id, CASE WHEN l.doc_id IS NULL OR text IS NULL THEN 'add' WHEN low = 0 THEN 'edited, kept' ELSE 'same' END AS action FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS low FROM labels GROUP BY doc_id) l USING (doc_id)",
    "o162_guide_rules_found": f"WITH q AS ({_QUOTES}) SELECT b.item_id AS item, count(q.key) AS found_in FROM benchmark b LEFT JOIN q ON q.item = b.item_id GROUP BY b.item_id",
    "o165_facet_added": f"WITH {M} SELECT key, concat(lang, '.', type, '._') AS slot FROM m",
    "o170_pair_separation": f"WITH {M}, p AS (SELECT a.type AS author, b.words / a.words AS r FROM m a JOIN m b ON b.key = a.key + 1 AND a.key % 2 = 0 WHERE a.words > 0) SELECT author, round(avg(r), 6) AS ratio, count(*) FILTER (r > 1) AS up, count(*) AS n, (avg(r) >= 1.25 AND count(*) FILTER (r > 1) >= 0.8 * count(*)) OR (avg(r) <= 1 / 1.25 AND count(*) FILTER (NOT r > 1) >= 0.8 * count(*)) AS separates FROM p GROUP BY author",
    "o171_leave_own_out": f"WITH {M}, g AS (SELECT type, sum(words) AS w, count(*) AS n FROM m GROUP BY type) SELECT m.key, round((g.w - m.words) / (g.n - 1), 6) AS others FROM m JOIN g ON g.type = m.type WHERE g.n > 1",
    "o172_threshold_sweep": f"WITH {_LONG}, mads AS (SELECT m.lang, m.type, m.median, (SELECT median(abs(distance - m.median)) FROM dist d WHERE d.lang = m.lang AND d.type = m.type) AS mad FROM mid m WHERE n >= 5) SELECT k, count(*) FILTER (distance > greatest(median + k * 1.4826 * mad, 1.5 * median)) AS flagged, count(*) AS n FROM dist JOIN mads USING (lang, type) CROSS JOIN (SELECT unnest([1.5e0, 2e0, 3e0, 4e0, 5e0]) AS k) GROUP BY k",
    "o175_balanced_labels": f"WITH {M} SELECT key, (row_number() OVER (ORDER BY key) - 1) % 4 AS label FROM m",
    "o176_inventory_compare": f"WITH {M}, {F} SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' WHEN m.key % 8 = 0 OR f.key = m.key THEN 'equal' ELSE 'differs' END AS outcome FROM f FULL OUTER JOIN (SELECT * FROM m WHERE key % 5 <> 4) m ON m.path = f.path",
    "o177_changed_since": "SELECT event_id, ts FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 3 DAY + INTERVAL 1 SECOND",
    "o178_expired_drafts": "WITH d AS (SELECT event_id AS id, ts AS created, max(ts) OVER () AS now FROM events) SELECT id, CASE WHEN created < now - INTERVAL 20 DAY THEN 'expired' ELSE 'open' END AS status FROM d",
    "o180_edit_queue": "WITH q AS (SELECT user_id AS item, event_type AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT item, state FROM q WHERE rn = 1",
    "o181_iso_weeks": "SELECT date_trunc('week', ts) AS week, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY date_trunc('week', ts), event_type",
    "o182_evidence_pruned": f"WITH {M} SELECT type AS lesson, count(*) AS seen_in, min(key) AS quote_from FROM m WHERE status <> 'forgotten' AND ownership <> 'other' GROUP BY type",
    "o183_nearest_ancestor": f"WITH RECURSIVE {CHAIN}, files AS (SELECT * FROM (VALUES ('base', 'en.flavour'), ('sam', 'de.flavour')) AS t(profile, file)), h AS (SELECT c.start, f.file, row_number() OVER (PARTITION BY c.start ORDER BY c.depth, f.file) AS rn FROM chain c JOIN files f ON f.profile = c.profile) SELECT start, file FROM h WHERE rn = 1",
    "o186_inherited_rulings": f"WITH RECURSIVE {CHAIN} SELECT start, profile AS inherited_from FROM chain WHERE depth > 0 AND consent <> 'self'",
    "o187_rule_facets": f"WITH {M}, r AS (SELECT * FROM (VALUES ('.', 'type', 'any', 0), ('dir1', 'type', 'essay', 1), ('dir1/sub1', 'type', 'note', 2), ('dir1', 'year', 'old', 1)) AS t(rule_path, facet, value, depth)), h AS (SELECT m.key, r.facet, r.value, row_number() OVER (PARTITION BY m.key, r.facet ORDER BY r.depth DESC) AS rn FROM m JOIN r ON {UNDER}) SELECT key, facet, value FROM h WHERE rn = 1",
    "o188_rule_coverage": f"WITH {M}, {RULES}, r AS (SELECT DISTINCT rule_path, profile FROM rules) SELECT rule_path, profile, count(DISTINCT m.key) AS texts FROM r LEFT JOIN m ON {UNDER} AND m.path NOT LIKE '%9.md' GROUP BY rule_path, profile",
    "o189_type_resolution": f"WITH {M} SELECT key, coalesce(CASE WHEN key % 4 = 0 THEN 'set' END, nullif(type, 'src1'), CASE WHEN path LIKE 'dir1/sub1/%' THEN 'note' WHEN folder = 'dir1' THEN 'essay' ELSE 'any' END) AS type FROM m",
    "o190_entry_lookup": f"WITH {M}, asked AS (SELECT DISTINCT CASE WHEN key % 9 = 0 THEN key::VARCHAR ELSE path END AS name FROM m WHERE key % 9 IN (0, 2)) SELECT name, key FROM m JOIN asked ON name = key::VARCHAR OR name = path",
    "o191_cascade_delete": f"WITH {M} SELECT m.key AS id, CASE WHEN l.key IS NULL THEN m.key + 1 END AS source, CASE WHEN l.key IS NULL THEN m.path END AS quote FROM m LEFT JOIN (SELECT key FROM m WHERE status = 'forgotten') l ON l.key = m.key + 1",
    "o192_restored": "SELECT doc_id AS id, lang AS body, (SELECT max(doc_id) + 1 FROM documents) AS next_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "o193_item_lookup": f"WITH {M}, items AS (SELECT 'lesson' AS artefact, * FROM m WHERE ownership = 'own' UNION ALL SELECT 'example', * FROM m WHERE holdout UNION ALL SELECT 'ruling', * FROM m WHERE status = 'superseded') SELECT artefact, key FROM items WHERE cached",
    "o194_stripped_records": f"WITH {M} SELECT key, concat_ws(',', CASE WHEN status NOT IN ('other', 'forgotten') THEN 'kim' END, CASE WHEN ownership NOT IN ('other', 'forgotten') THEN 'sam' END) AS profiles FROM m",
    "o195_requirements": f"WITH {M} SELECT folder, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM m GROUP BY folder",
    "o196_emptied_slots": f"WITH {M}, {OWN}, slots AS (SELECT DISTINCT lang, type FROM m) SELECT s.lang, s.type FROM slots s LEFT JOIN own o ON o.lang = s.lang AND o.type = s.type WHERE o.key IS NULL",
    "o197_rejections": "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'example' ELSE 'lesson' END AS kind, CASE WHEN doc_id % 2 = 1 THEN length(text) END AS kept_chars, sha256(text) AS digest FROM documents WHERE doc_id % 3 = 0",
    "o198_profile_snapshot": f"WITH {M} SELECT key, path, status FROM m WHERE folder <> 'dir1' OR path LIKE 'dir1/sub1/%'",
    "o200_approved_view": f"WITH {M}, patch AS (SELECT key, 'superseded' AS status, false AS removed FROM m WHERE key % 10 = 1 UNION ALL SELECT key, NULL, true FROM m WHERE key % 10 = 2 UNION ALL SELECT key + 5000000, 'active', false FROM m WHERE key % 10 = 3), p AS (SELECT * FROM patch WHERE key % 4 <> 0) SELECT coalesce(p.key, m.key) AS key, coalesce(p.status, m.status) AS status FROM m FULL OUTER JOIN p ON p.key = m.key WHERE NOT coalesce(p.removed, false)",
    "o201_kept_drafts": f"SELECT min(doc_id) AS id, count(*) AS copies, min({O.n_words(_TEXT)}) AS words FROM documents GROUP BY trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))",
    "o202_published_summary": f"WITH {M} SELECT type, count(*) AS n, sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END) AS active FROM m GROUP BY type",
    "o203_learnable_names": f"WITH {M} SELECT key, path FROM m WHERE key % 10 NOT IN (0, 1)",
    "o204_copied_files": f"WITH {M}, ledger AS (SELECT path, words FROM m WHERE key % 2 = 0), copied AS (SELECT path, words + 1 AS words FROM m WHERE key % 3 = 0) SELECT coalesce(c.path, l.path) AS path, coalesce(c.words, l.words) AS words FROM ledger l FULL OUTER JOIN copied c ON c.path = l.path",
    "o205_pack_caveats": "SELECT DISTINCT lang, CASE WHEN lang = 'en' THEN NULL WHEN lang IN ('de', 'fr', 'es') THEN 'the thresholds were calibrated on English' ELSE 'no language pack' END AS caveat FROM (SELECT lang FROM documents UNION SELECT 'nl' UNION SELECT 'xx')",
    "o207_kit_caps": f"WITH {M}, r AS (SELECT key, type, row_number() OVER (PARTITION BY type ORDER BY CASE WHEN ownership = 'own' THEN 0 ELSE 1 END, key) AS rn FROM m) SELECT key, type, rn FROM r WHERE rn <= 30",
    "o210_one_ruling": f"WITH {M}, r AS (SELECT key AS id FROM m WHERE holdout) SELECT id FROM r UNION ALL SELECT max(id) + 1 FROM r",
    "o211_sign_override": "WITH s AS (SELECT * FROM (VALUES ('s1', 'always'), ('s2', 'unless_writer')) AS t(id, tier)) SELECT id, tier = 'unless_writer' AS may_switch_off FROM s",
    "o212_next_steps": "SELECT * FROM (VALUES ('measure', 3), ('commit', 4)) AS t(step, place)",
    "o214_pending_status": f"WITH {M} SELECT sum(CASE WHEN ownership = 'undecided' THEN 1 ELSE 0 END) AS pending, sum(CASE WHEN ownership <> 'undecided' THEN 1 ELSE 0 END) AS decided, count(*) AS items FROM m",
    "o215_fresh_round_robin": f"WITH {M}, {OWN}, used AS (SELECT key FROM own WHERE key % 3 = 0), r AS (SELECT o.key, o.type, row_number() OVER (PARTITION BY o.type ORDER BY o.key) AS rn FROM own o LEFT JOIN used u ON u.key = o.key WHERE u.key IS NULL) SELECT key, type, rn FROM r ORDER BY rn, type LIMIT 40",
    "o216_draft_length": f"WITH {M}, t AS (SELECT type, avg(words) AS target FROM m GROUP BY type) SELECT m.key, words >= 0.85 * target AND words <= 1.15 * target AS fits FROM m JOIN t USING (type)",
    "o218_scaled_answers": "WITH a AS (SELECT event_type AS answer, user_id AS choice, sum(value) AS p FROM events GROUP BY ALL) SELECT answer, choice, round(p * 100 / (SELECT sum(p) FROM a b WHERE b.answer = a.answer), 5) AS percent FROM a WHERE p > 0",
    "o219_spot_check": f"WITH {M}, r AS (SELECT key, type, row_number() OVER (PARTITION BY type ORDER BY md5(CAST(key AS STRING))) AS rn, count(*) OVER (PARTITION BY type) AS n FROM m) SELECT key, type FROM r WHERE rn <= greatest(1, ceil(n / 10.0))",
    "o220_detector_shift": "WITH s AS (SELECT source AS type, length(regexp_replace(text, '[^e]', '', 'g')) AS score, quality = 1 AS own FROM documents JOIN labels USING (doc_id)) SELECT type, round(avg(score) FILTER (own), 6) AS own_mean, max(score) FILTER (NOT own) AS other_max, round(avg(score) FILTER (own) - avg(score) FILTER (NOT own), 6) AS shift FROM s GROUP BY type",
    "o221_screened_authors": "SELECT source AS author, round(avg(toxic * 100e0), 6) AS probability FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING avg(toxic * 100) < 30",
    "o222_report_cut": "SELECT doc_id AS key, md5(CASE WHEN contains(text, chr(10) || '## Report') THEN split_part(text, chr(10) || '## Report', 1) ELSE text END) AS digest FROM documents",
    "o223_flags_by_group": f"WITH {M} SELECT type, lang, count(*) AS n, sum(CASE WHEN words < 150 THEN 1 ELSE 0 END) AS flagged FROM m GROUP BY GROUPING SETS ((type), (lang))",
    "o225_essay_slices": f"WITH {M}, t AS (SELECT folder, type AS title, max(key) AS line FROM m GROUP BY ALL) SELECT folder, title, line, lead(line) OVER (PARTITION BY folder ORDER BY line) AS until_line FROM t",
    "o227_author_holdouts": f"WITH {M}, r AS (SELECT key, folder, row_number() OVER (PARTITION BY folder ORDER BY md5(concat('x/', CAST(key AS STRING)))) AS rn FROM m) SELECT key, folder FROM r WHERE rn <= 3",
}
SQL["o154_staged_texts"] = f"WITH RECURSIVE i AS ({SQL['o151_inventory']}), o AS (SELECT key, max(decision = 'question') AS asks FROM ({SQL['o152_ownership_decisions']}) GROUP BY key) SELECT i.key, CASE WHEN starts_with(result, 'skipped') OR result IN ('unchanged', 'forgotten', 'holdout') THEN 'nothing' WHEN coalesce(asks, false) THEN 'ask' WHEN result = 'renamed' THEN 'repath' WHEN result = 'changed' THEN 'supersede' ELSE 'create' END AS change FROM i LEFT JOIN o USING (key)"
SQL["o206_pack_listing"] = "SELECT * FROM (VALUES ('en', 14, 17, 6), ('de', 14, 25, 7), ('fr', 14, 20, 7), ('es', 14, 22, 7)) AS t(lang, metrics, hedges, openers)"
_G = "lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)"
SQL["o108_win_rates"] = f"""WITH a AS (SELECT source AS type, CASE WHEN toxic = 1 THEN 0.5e0 ELSE quality END AS win FROM documents JOIN labels USING (doc_id)), g AS (SELECT type, count(*) AS total, count(*) FILTER (win = 0.5) AS ties, count(*) FILTER (win = 1) AS w, avg(win) AS rate FROM a GROUP BY type),
h AS (SELECT *, total - ties AS n, greatest(w, total - ties - w) AS k FROM g), t AS (SELECT type, sum(exp({_G})) AS tail FROM (SELECT type, n, unnest(range(k, n + 1)) AS i FROM h WHERE k > 0) GROUP BY type)
SELECT type, total AS n, ties, round(rate, 6) AS rate, round(CASE WHEN k <= 0 THEN 1 ELSE least(1, 2 * tail) END, 6) AS p FROM h LEFT JOIN t USING (type)"""
_SUMS = ", ".join(f"sum({s}) AS {s}" for s in O.SUMS)
SQL["o184_drift_per_metric"] = f"""WITH {O.sums(O.DOCS)}, g AS (SELECT lang, {_SUMS} FROM sums GROUP BY lang), gv AS (SELECT lang, {O.value_columns()} FROM g), slot AS ({O.melted('gv', 'lang')}), h AS (SELECT lang, type, {_SUMS} FROM sums GROUP BY lang, type),
hv AS (SELECT lang, type, {O.value_columns()} FROM h), got AS ({O.melted('hv', 'lang, type')}), {O.metric_table()} SELECT x.lang, x.type, x.metric, round(ln(greatest(x.value, floor) / greatest(s.value, floor)), 5) AS drift FROM got x JOIN slot s USING (lang, metric) JOIN metric_table USING (metric)"""
