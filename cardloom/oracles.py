"""The same queries as plain SQL for DuckDB, written from the rules, not from the Spark plans."""

from __future__ import annotations

CARDS = """cards AS (
  SELECT *, CASE WHEN type_line LIKE '%Land%' THEN '' ELSE '{' || mana_value::INT || '}' ||
    CASE WHEN bit_count(ci_mask) = 2 THEN '{' || array_to_string(letters, '/') || '}'
         ELSE array_to_string(list_transform(letters, lambda c: '{' || c || '}'), '') END END AS mana_cost,
    array_to_string(letters, '') AS identity
  FROM (
    SELECT *, list_filter([
        CASE WHEN ci_mask & 1 <> 0 THEN 'W' END, CASE WHEN ci_mask & 2 <> 0 THEN 'U' END,
        CASE WHEN ci_mask & 4 <> 0 THEN 'B' END, CASE WHEN ci_mask & 8 <> 0 THEN 'R' END,
        CASE WHEN ci_mask & 16 <> 0 THEN 'G' END], lambda c: c IS NOT NULL) AS letters
    FROM (
      SELECT p_partkey AS id, 'o' || p_partkey AS oracle_id, p_name || ' ' || p_partkey AS name, p_name,
        (p_size % 10)::DOUBLE AS mana_value,
        CASE p_type WHEN 'ECONOMY' THEN 'Basic Land' WHEN 'PROMO' THEN 'Land'
          WHEN 'LARGE' THEN 'Legendary Creature' WHEN 'MEDIUM' THEN 'Creature'
          WHEN 'SMALL' THEN 'Instant' WHEN 'STANDARD' THEN 'Artifact' END AS type_line,
        (7 * regexp_extract(p_brand, '[0-9]+')::INT + p_size) % 32 AS ci_mask
      FROM part)))"""

ROLED = """roled AS (
  SELECT *, CASE split_part(p_name, ' ', 2) WHEN 'bolt' THEN 'Removal' WHEN 'ring' THEN 'Ramp'
      WHEN 'gear' THEN 'Card Draw' WHEN 'plate' THEN 'Protection' WHEN 'rod' THEN 'Oddity'
      ELSE CASE WHEN type_line LIKE '%Land%' THEN 'Land' ELSE 'Utility' END END AS primary_role
  FROM cards)"""

COLLECTION = """collection AS (
  SELECT o_custkey AS user_id, l_partkey AS card_id, sum(l_quantity)::BIGINT AS quantity
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""

DECKS = """deck_lines AS (
  SELECT l_orderkey AS deck_id, l_partkey AS card_id, sum(l_quantity)::BIGINT AS quantity
  FROM lineitem GROUP BY ALL),
decks AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS name, o_orderdate AS created_at,
    o_orderdate AS updated_at, o_orderstatus, commander_id
  FROM orders LEFT JOIN (
    SELECT deck_id, min(card_id) AS commander_id FROM deck_lines JOIN cards ON card_id = id
    WHERE type_line = 'Legendary Creature' GROUP BY deck_id) ON o_orderkey = deck_id),
deck_cards AS (
  SELECT l.* FROM deck_lines l JOIN decks d ON d.id = l.deck_id
  WHERE d.commander_id IS DISTINCT FROM l.card_id)"""

EVENTS = """ev AS (
  SELECT *, (props->>'$.k')::BIGINT AS k FROM events)"""

REQUESTS = """context AS (
  SELECT DISTINCT request_id, l_partkey AS card_id
  FROM (SELECT o_custkey AS request_id, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey)
  JOIN lineitem ON l_orderkey = first_order),
requests AS (
  SELECT c_custkey AS request_id, c_custkey AS user_id,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'strongest'
         WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 'prefer' ELSE 'only' END AS pref,
    CASE WHEN c_acctbal < 0 THEN 'Casual' WHEN c_acctbal < 5000 THEN 'Focused' ELSE 'Competitive' END AS power_level
  FROM customer),
wanted AS (
  SELECT request_id, user_id, pref, power_level, coalesce(n_context, 0) AS n_context, names,
    CASE WHEN coalesce(m, 0) = 0 THEN 17 ELSE m END AS wanted_mask
  FROM requests LEFT JOIN (
    SELECT request_id, count(*)::INT AS n_context, bit_or(ci_mask) AS m, string_agg(name, ', ' ORDER BY id) AS names
    FROM context JOIN cards ON card_id = id GROUP BY request_id) USING (request_id))"""

GENERATE = """legend_scores AS MATERIALIZED (
  SELECT w.request_id, c.id, c.ci_mask, c.identity, c.name, row_number() OVER (PARTITION BY w.request_id ORDER BY
      (w.wanted_mask & ~c.ci_mask) = 0 DESC, bit_count(c.ci_mask & w.wanted_mask) DESC, bit_count(c.ci_mask) DESC,
      (w.pref = 'prefer' AND o.card_id IS NOT NULL) DESC, c.id) AS rn
  FROM wanted w JOIN cards c ON c.type_line = 'Legendary Creature'
  LEFT JOIN collection o ON o.user_id = w.user_id AND o.card_id = c.id AND o.quantity > 0
  WHERE w.pref <> 'only' OR o.card_id IS NOT NULL),
leaders AS MATERIALIZED (
  SELECT w.*, s.id AS commander_id, s.ci_mask AS commander_mask, s.identity, s.name AS commander_name
  FROM wanted w LEFT JOIN legend_scores s ON s.request_id = w.request_id AND s.rn = 1),
fitting AS MATERIALIZED (
  SELECT l.request_id, c.id, c.type_line, c.primary_role, x.card_id IS NOT NULL AS is_context,
    (l.pref = 'prefer' AND o.card_id IS NOT NULL) AS is_own, l.commander_id, l.identity
  FROM leaders l JOIN roled c ON c.ci_mask & ~l.commander_mask = 0
  LEFT JOIN context x ON x.request_id = l.request_id AND x.card_id = c.id
  LEFT JOIN collection o ON o.user_id = l.user_id AND o.card_id = c.id AND o.quantity > 0
  WHERE l.pref <> 'only' OR o.card_id IS NOT NULL),
spells AS MATERIALIZED (
  SELECT * FROM (
    SELECT request_id, id AS card_id, primary_role AS role,
      row_number() OVER (PARTITION BY request_id ORDER BY is_context DESC, is_own DESC, id)::INT AS rank
    FROM fitting WHERE type_line NOT LIKE '%Land%' AND id <> commander_id) WHERE rank <= 63),
need AS MATERIALIZED (
  SELECT l.request_id, l.identity, (99 - count(s.card_id))::INT AS lands_needed
  FROM leaders l LEFT JOIN spells s USING (request_id) WHERE l.commander_id IS NOT NULL GROUP BY ALL),
nonbasics AS MATERIALIZED (
  SELECT r.request_id, r.card_id, r.rank FROM (
    SELECT request_id, id AS card_id, row_number() OVER (PARTITION BY request_id ORDER BY is_own DESC, id)::INT AS rank
    FROM fitting WHERE type_line = 'Land') r JOIN need n USING (request_id)
  WHERE r.rank <= n.lands_needed - length(n.identity)),
slots AS (
  SELECT request_id, color, rank, (need // n + CASE WHEN rank - 1 < need % n THEN 1 ELSE 0 END)::INT AS quantity FROM (
    SELECT request_id, need, n, unnest(string_split(colors, '')) AS color, unnest(range(1, n + 1))::INT AS rank FROM (
      SELECT request_id, CASE WHEN identity = '' THEN 'GW' ELSE identity END AS colors,
        CASE WHEN identity = '' THEN 2 ELSE length(identity) END AS n, lands_needed - coalesce(taken, 0) AS need
      FROM need LEFT JOIN (SELECT request_id, count(*) AS taken FROM nonbasics GROUP BY request_id) USING (request_id)))),
basics AS (
  SELECT CASE ci_mask WHEN 1 THEN 'W' WHEN 2 THEN 'U' WHEN 4 THEN 'B' WHEN 8 THEN 'R' WHEN 16 THEN 'G' END AS color,
    min(id) AS card_id
  FROM cards WHERE type_line = 'Basic Land' AND ci_mask IN (1, 2, 4, 8, 16) GROUP BY ALL),
generated AS (
  SELECT request_id, 'spell' AS section, rank, card_id, 1 AS quantity FROM spells
  UNION ALL SELECT request_id, 'land', rank, card_id, 1 FROM nonbasics
  UNION ALL SELECT request_id, 'basic', rank, b.card_id, quantity FROM (
    SELECT request_id, color, quantity, row_number() OVER (PARTITION BY request_id ORDER BY rank)::INT AS rank
    FROM slots WHERE quantity > 0) JOIN basics b USING (color))"""

ADDS = """adds AS (
  SELECT event_id AS seq, user_id, k * 30 AS card_id, floor(value)::BIGINT AS quantity
  FROM ev WHERE event_type = 'purchase')"""

DECK_OPS = """ops AS (
  SELECT coalesce(o_custkey, user_id) AS user_id, event_id AS seq,
    CASE WHEN event_type = 'error' THEN 'delete' ELSE 'save' END AS op,
    target AS deck_id, 'deck of event ' || event_id AS name, k AS commander_id, ts
  FROM (SELECT *, CASE WHEN event_type <> 'signup' THEN user_id * 10 + k % 10 END AS target
        FROM ev WHERE event_type <> 'view') LEFT JOIN orders ON o_orderkey = target),
gone AS (SELECT deck_id, min(seq) AS at FROM ops WHERE op = 'delete' GROUP BY deck_id),
judged AS (
  SELECT o.*, CASE
      WHEN o.op = 'save' AND d.id IS NOT NULL AND (g.at IS NULL OR o.seq < g.at) THEN 'update'
      WHEN o.op = 'save' THEN 'create' WHEN d.id IS NOT NULL AND o.seq = g.at THEN 'delete' ELSE 'none' END AS effect
  FROM ops o LEFT JOIN decks d ON d.id = o.deck_id LEFT JOIN gone g ON g.deck_id = o.deck_id),
flags AS (
  SELECT user_id, seqs, list_reduce(steps,
    lambda s, x: list_concat([s[1] + CASE WHEN x[1] = 1 AND s[1] >= 12 THEN 0 ELSE x[1] END], s[2:],
                             [CASE WHEN x[1] = 1 AND s[1] >= 12 THEN 0 ELSE 1 END]), [coalesce(n, 0)]) AS f
  FROM (SELECT user_id, list(seq ORDER BY seq) AS seqs,
          list(CASE WHEN effect = 'create' THEN [1::BIGINT] ELSE [-1::BIGINT] END ORDER BY seq) AS steps
        FROM judged WHERE effect IN ('create', 'delete') GROUP BY user_id)
  LEFT JOIN (SELECT user_id, count(*) AS n FROM decks GROUP BY user_id) USING (user_id)),
verdicts AS (SELECT user_id, unnest(seqs) AS seq, unnest(f[2:]) = 1 AS accepted FROM flags)"""

EDITS = """edit_log AS (
  SELECT * FROM (SELECT user_id AS deck_id, event_id AS seq, k AS card_id, CASE
      WHEN event_type IN ('click', 'purchase') THEN 'add' WHEN event_type = 'error' THEN 'remove'
      WHEN event_type = 'signup' THEN 'set_commander' WHEN value > 60 THEN 'clear'
      WHEN value < 2 THEN 'remove_commander' END AS op
    FROM ev) WHERE op IS NOT NULL),
live AS (
  SELECT l.* FROM edit_log l LEFT JOIN (SELECT deck_id, max(seq) AS at FROM edit_log WHERE op = 'clear' GROUP BY deck_id) c
    USING (deck_id) WHERE c.at IS NULL OR l.seq > c.at),
led AS (
  SELECT deck_id, seq, op, CASE WHEN op = 'set_commander' THEN card_id END AS leader FROM live
  WHERE op IN ('set_commander', 'remove_commander'))"""

RETRIEVAL = """asked AS (
  SELECT request_id, bit_or(ci_mask) AS mask, list_sort(list_distinct(list(primary_role))) AS roles,
    list_sort(list_distinct(list(type_line))) AS themes,
    list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))) AS mechanics
  FROM context JOIN roled ON id = card_id GROUP BY request_id),
asked_vectors AS (
  SELECT request_id, list(x ORDER BY i) AS vector FROM (
    SELECT request_id, i, avg(x) AS x FROM (
      SELECT request_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i
      FROM context JOIN embeddings ON vec_id = card_id) GROUP BY ALL) GROUP BY request_id),
nearest AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, card_id)::INT AS rank FROM (
    SELECT request_id, vec_id AS card_id, round(list_cosine_similarity(vector, embedding::DOUBLE[]), 6) AS score
    FROM asked_vectors, embeddings)),
synergistic AS (
  SELECT * FROM (
    SELECT request_id, card_id, round(overlap / n, 6) AS score,
      row_number() OVER (PARTITION BY request_id ORDER BY overlap DESC, card_id)::INT AS rank
    FROM (
      SELECT request_id, c.id AS card_id, len(mechanics) AS n, len(list_intersect(mechanics, string_split(p_name, ' '))) AS overlap
      FROM asked, cards c) WHERE overlap > 0) WHERE rank <= 50),
supporting AS (
  SELECT request_id, card_id, 0.5::DOUBLE AS score FROM (
    SELECT request_id, c.id AS card_id, row_number() OVER (PARTITION BY request_id, c.primary_role ORDER BY c.id) AS rank
    FROM asked JOIN roled c ON c.ci_mask & ~mask = 0
    WHERE c.primary_role IN ('Ramp', 'Card Draw', 'Removal', 'Protection')) WHERE rank <= 10),
mixed AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, card_id)::INT AS rank FROM (
    SELECT request_id, card_id, max(score) AS score, string_agg(kind, '+' ORDER BY kind) AS kinds FROM (
      SELECT request_id, card_id, score, 'similar' AS kind FROM nearest WHERE rank <= 100
      UNION ALL SELECT request_id, card_id, score, 'synergistic' FROM synergistic
      UNION ALL SELECT request_id, card_id, score, 'supporting' FROM supporting) GROUP BY ALL) QUALIFY rank <= 200)"""

METADATA = """answers AS (
  SELECT doc_id AS card_id, source, lang, n_chars / 500.0 AS rating, coalesce(toxic, 0) AS toxic,
    (['Early', 'Mid', 'Late', 'Endless'])[doc_id % 4 + 1] AS stage
  FROM documents LEFT JOIN labels USING (doc_id)),
judged_answers AS (
  SELECT *, CASE WHEN toxic = 1 THEN 'malformed' WHEN stage = 'Endless' THEN 'game stage' END AS reason FROM answers)"""

BOUNDED = """bounded_answers AS (
  SELECT *, CASE WHEN toxic = 1 THEN 'malformed' WHEN stage = 'Endless' THEN 'game stage'
    WHEN rating > 10 THEN 'power rating' END AS reason FROM answers)"""

CSV = """csv_rows AS (
  SELECT event_id, user_id, p_partkey, CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT END AS quantity
  FROM ev LEFT JOIN part ON p_partkey = k * 30),
csv_judged AS (
  SELECT *, CASE WHEN quantity IS NULL THEN 'malformed' WHEN quantity <= 0 THEN 'quantity'
    WHEN p_partkey IS NULL THEN 'unknown card' END AS reason FROM csv_rows)"""

RESPONSES = """basic AS (SELECT * FROM cards WHERE type_line = 'Basic Land' ORDER BY id LIMIT 1),
answered AS (
  SELECT event_id AS request_id, (k % 4)::INT AS attempt, event_type, event_id % 2 AS odd,
    a.type_line AS leader_type, a.ci_mask AS leader_mask, b.id AS b, b.type_line AS bt, b.ci_mask AS bm,
    c.id AS c, c.type_line AS ct, c.ci_mask AS cm, z.id AS z, z.ci_mask AS zm
  FROM ev JOIN cards a ON a.id = k JOIN cards b ON b.id = k + 1 JOIN cards c ON c.id = k + 2, basic z),
answer_cards AS (
  SELECT request_id, b AS id, bt AS type_line, bm AS ci_mask, 1 AS quantity FROM answered
  UNION ALL SELECT request_id, c, ct, cm, 1 + odd FROM answered
  UNION ALL SELECT request_id, z, 'Basic Land', zm, 97 - odd - (event_type = 'view')::INT FROM answered),
answer_sums AS (
  SELECT request_id, bit_or(ci_mask) AS mask,
    count(*) FILTER (NOT contains(type_line, 'Basic Land') AND quantity > 1) AS repeated, sum(quantity) AS n
  FROM (SELECT request_id, id, type_line, ci_mask, sum(quantity) AS quantity FROM answer_cards GROUP BY ALL) GROUP BY request_id),
checked AS (
  SELECT request_id, attempt, CASE WHEN event_type = 'error' THEN 'answer is not readable' ELSE concat_ws('; ',
    CASE WHEN n + (event_type = 'view')::INT + 1 <> 100 THEN 'expected 100 cards, found ' || (n + (event_type = 'view')::INT + 1) END,
    CASE WHEN leader_type <> 'Legendary Creature' THEN 'commander is not a legendary creature' END,
    CASE WHEN mask & ~leader_mask <> 0 THEN 'cards outside the commander''s color identity' END,
    CASE WHEN repeated > 0 THEN repeated || ' cards exceed 1 copy' END,
    CASE WHEN event_type = 'view' THEN '1 unknown card names' END) END AS errors
  FROM answered JOIN answer_sums USING (request_id))"""


KNOWLEDGE = """
SELECT doc_id AS card_id, concat_ws(chr(10) || chr(10), 'Card:', 'document ' || doc_id,
  CASE WHEN quality IS NOT NULL THEN 'Summary:' END, CASE WHEN quality IS NOT NULL THEN 'Text from ' || source END,
  CASE WHEN quality IS NOT NULL THEN 'Roles:' END, CASE WHEN quality IS NOT NULL THEN 'Text' || chr(10) || lang END,
  CASE WHEN quality = 1 THEN 'Themes:' END, CASE WHEN quality = 1 THEN 'Good' END,
  CASE WHEN toxic = 1 THEN 'Weakness:' END, CASE WHEN toxic = 1 THEN 'Toxic' END,
  'Oracle Text:', text) AS document
FROM documents LEFT JOIN labels USING (doc_id)"""

# A word's slot: the first 32 bits of its md5 modulo 512.
TERMS = """docs AS (""" + KNOWLEDGE + """),
terms AS (
  SELECT card_id, (('0x' || substr(md5(word), 1, 8))::BIGINT % 512)::INT AS slot, count(*) AS times FROM (
    SELECT card_id, unnest(string_split_regex(lower(document), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM docs) WHERE word <> '' GROUP BY ALL),
frequencies AS (SELECT slot, count(*) AS documents FROM terms GROUP BY slot),
weighed AS (SELECT card_id, slot, times * ln(((SELECT count(*) FROM docs) + 1) / (documents + 1)) AS w FROM terms JOIN frequencies USING (slot)),
norms AS (SELECT card_id, sqrt(sum(w * w)) AS norm, max(w) AS top, count(*) FILTER (w > 0)::INT AS n_used FROM weighed GROUP BY card_id)"""

LOOP_JUDGED = """(SELECT r.*, CASE WHEN attempt = 1 AND request_id % 7 = 0 THEN 'answer is not readable' ELSE concat_ws('; ',
    CASE WHEN request_id % 3 = 0 AND NOT sized THEN 'expected 100 cards, found 99' END,
    CASE WHEN a.type_line <> 'Legendary Creature' THEN 'commander is not a legendary creature' END,
    CASE WHEN (z.ci_mask | CASE WHEN fewer THEN 0 ELSE b.ci_mask | c.ci_mask END) & ~a.ci_mask <> 0
      THEN 'cards outside the commander''s color identity' END,
    CASE WHEN request_id % 2 = 1 AND NOT single AND NOT fewer AND c.type_line <> 'Basic Land' THEN '1 cards exceed 1 copy' END,
    CASE WHEN request_id % 5 = 0 AND NOT named THEN '1 unknown card names' END) END AS errors
  FROM {rounds} r JOIN cards a ON a.id = k + least(shift, 5) JOIN cards b ON b.id = k + 6 JOIN cards c ON c.id = k + 7,
    (SELECT arg_min(ci_mask, (ci_mask <> 0, id)) AS ci_mask FROM cards WHERE type_line = 'Basic Land') z)"""

# What earlier errors have made the builder do stays done.
LOOP = """tried AS (
  SELECT event_id AS request_id, k, 1 AS attempt, 0 AS shift, FALSE AS sized, FALSE AS fewer, FALSE AS single, FALSE AS named FROM ev
  UNION ALL
  SELECT request_id, k, attempt + 1, shift + contains(errors, 'legendary')::INT, sized OR contains(errors, 'expected'),
    fewer OR contains(errors, 'outside'), single OR contains(errors, 'exceed'), named OR contains(errors, 'unknown')
  FROM """ + LOOP_JUDGED.format(rounds="tried") + """ WHERE errors <> '' AND attempt < 4)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


DECK_BASE = (CARDS, DECKS)
GEN_BASE = (CARDS, ROLED, COLLECTION, REQUESTS, GENERATE)

ORACLES: dict[str, str] = {
    "collection_browse": _with(CARDS, COLLECTION) + """
SELECT user_id, id, name, mana_value, quantity FROM cards JOIN collection ON card_id = id
WHERE quantity <> 0 AND contains(lower(name), 'bolt') AND contains(type_line, 'Creature') AND (ci_mask & 3 <> 0 OR ci_mask = 0)""",
    "catalog_search_topk": _with(CARDS) + """
SELECT query, rank, card_id FROM (
  SELECT query, id AS card_id, row_number() OVER (PARTITION BY query ORDER BY id)::INT AS rank
  FROM (SELECT DISTINCT unnest(string_split(p_name || ' ' || type_line, ' ')) AS query FROM cards) q
  JOIN cards ON contains(lower(name), lower(query)) OR contains(lower(type_line), lower(query)))
WHERE rank <= 20""",
    "facet_counts": _with(CARDS, COLLECTION) + """
SELECT user_id, facet, count(*) AS n_cards FROM (
  SELECT user_id, unnest(CASE WHEN identity = '' THEN ['C'] ELSE letters END) AS facet
  FROM cards JOIN collection ON card_id = id WHERE quantity <> 0) GROUP BY ALL""",
    "color_sort_keys": _with(CARDS) + """
SELECT id, CASE WHEN contains(type_line, 'Land') THEN 7 WHEN ci_mask = 0 THEN 6 WHEN bit_count(ci_mask) > 1 THEN 5
  WHEN ci_mask = 1 THEN 0 WHEN ci_mask = 2 THEN 1 WHEN ci_mask = 4 THEN 2 WHEN ci_mask = 8 THEN 3 ELSE 4 END AS color_key
FROM cards""",
    "collection_totals": _with(COLLECTION) + """
SELECT user_id, sum(quantity)::BIGINT AS total_copies FROM collection GROUP BY user_id""",
    "collection_upsert": _with(COLLECTION, EVENTS, ADDS) + """
SELECT user_id, card_id, sum(quantity)::BIGINT AS quantity FROM (
  SELECT * FROM collection UNION ALL
  SELECT user_id, card_id, least(99, greatest(1, quantity)) FROM adds WHERE card_id IN (SELECT p_partkey FROM part))
GROUP BY ALL""",
    "collection_upsert_rejects": _with(EVENTS, ADDS) + """
SELECT seq, user_id, card_id FROM adds WHERE card_id NOT IN (SELECT p_partkey FROM part)""",
    "collection_merge": _with(COLLECTION, EVENTS, ADDS) + """
, newer AS (SELECT user_id, card_id, max(quantity) AS quantity FROM adds GROUP BY ALL)
SELECT coalesce(n.user_id, c.user_id) AS user_id, coalesce(n.card_id, c.card_id) AS card_id,
  coalesce(n.quantity, c.quantity) AS quantity
FROM collection c FULL JOIN newer n ON c.user_id = n.user_id AND c.card_id = n.card_id""",
    "deck_sizes": _with(*DECK_BASE) + """
SELECT deck_id, user_id, deck_size, CASE WHEN deck_size = 100 THEN 'complete' WHEN deck_size > 100 THEN 'over' ELSE 'under' END AS status
FROM (SELECT id AS deck_id, user_id, (coalesce(sum(quantity), 0) + (commander_id IS NOT NULL)::INT)::BIGINT AS deck_size
      FROM decks LEFT JOIN deck_cards ON deck_id = id GROUP BY id, user_id, commander_id)""",
    "decks_per_user_cap": """
SELECT o_custkey AS user_id, count(*) AS n_decks, count(*) >= 12 AS at_cap FROM orders GROUP BY ALL""",
    "deck_commanders": _with(*DECK_BASE) + """
SELECT d.id, d.commander_id, c.name AS commander_name, coalesce(c.name || ' deck', 'Untitled deck') AS default_name,
  strftime(updated_at, '%b %-d, %Y') AS updated_label
FROM decks d LEFT JOIN cards c ON c.id = d.commander_id""",
    "cards_by_ids": _with(*DECK_BASE) + """
SELECT id, name FROM cards WHERE id IN (SELECT commander_id FROM decks WHERE commander_id IS NOT NULL)""",
    "owned_missing_split": _with(*DECK_BASE, COLLECTION) + """
SELECT x.deck_id, x.card_id, x.quantity, coalesce(c.quantity // 20, 0) AS owned_quantity,
  greatest(x.quantity - coalesce(c.quantity // 20, 0), 0) AS missing_quantity,
  coalesce(c.quantity // 20, 0) > 0 AS owned, coalesce(c.quantity // 20, 0) <= 0 AS proxy
FROM deck_cards x JOIN decks d ON d.id = x.deck_id
LEFT JOIN collection c ON c.user_id = d.user_id AND c.card_id = x.card_id""",
    "addable_cards": _with(*DECK_BASE) + """
, found AS (SELECT * FROM (
  SELECT q, id AS card_id, type_line, row_number() OVER (PARTITION BY q ORDER BY id)::INT AS rank
  FROM (VALUES ('bolt'), ('ring'), ('basic land')) v(q) JOIN cards
    ON contains(lower(name), q) OR contains(lower(type_line), q)) WHERE rank <= 20)
SELECT d.id AS deck_id, rank, f.card_id, coalesce(x.card_id IS NOT NULL OR d.commander_id = f.card_id, FALSE) AS in_deck,
  NOT coalesce(x.card_id IS NOT NULL OR d.commander_id = f.card_id, FALSE) OR contains(f.type_line, 'Basic Land') AS addable
FROM decks d JOIN found f ON f.q = CASE o_orderstatus WHEN 'F' THEN 'bolt' WHEN 'O' THEN 'ring' ELSE 'basic land' END
LEFT JOIN deck_cards x ON x.deck_id = d.id AND x.card_id = f.card_id""",
    "deck_export": _with(*DECK_BASE) + """
SELECT d.id AS deck_id, 'Commander' AS section, '1 ' || c.name AS line FROM decks d JOIN cards c ON c.id = d.commander_id
UNION ALL SELECT deck_id, 'Deck', quantity || ' ' || c.name FROM deck_cards x JOIN cards c ON c.id = x.card_id""",
    "pip_demand": _with(*DECK_BASE) + """
SELECT deck_id, CASE WHEN length(s) > 1 AND contains(s, '/') THEN regexp_replace(s, '/', '') ELSE s END AS symbol,
  sum(quantity)::BIGINT AS pips
FROM (SELECT deck_id, quantity, unnest(regexp_extract_all(mana_cost, '\\{([^}]+)\\}', 1)) AS s
      FROM deck_cards JOIN cards ON card_id = id) GROUP BY ALL""",
    "deck_upsert_lww": _with(*DECK_BASE, EVENTS, DECK_OPS) + """
SELECT d.id::VARCHAR AS id, d.user_id, coalesce(u.name, d.name) AS name,
  CASE WHEN u.name IS NULL THEN d.commander_id ELSE u.commander_id END AS commander_id,
  d.created_at, coalesce(u.ts, d.updated_at) AS updated_at
FROM decks d LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY seq DESC) AS rn FROM judged WHERE effect = 'update') u
  ON u.deck_id = d.id AND u.rn = 1
WHERE d.id NOT IN (SELECT deck_id FROM judged WHERE effect = 'delete')
UNION ALL
SELECT 'deck-' || sha256(j.user_id || ':' || j.seq), j.user_id, j.name, j.commander_id, j.ts, j.ts
FROM judged j JOIN verdicts v ON v.user_id = j.user_id AND v.seq = j.seq WHERE j.effect = 'create' AND v.accepted""",
    "deck_cards_after": _with(*DECK_BASE, EVENTS, DECK_OPS) + """
, saved AS (SELECT * FROM judged WHERE effect = 'update' QUALIFY row_number() OVER (PARTITION BY deck_id ORDER BY seq DESC) = 1),
removed AS (SELECT deck_id FROM judged WHERE effect = 'delete')
SELECT deck_id::VARCHAR AS deck_id, card_id, quantity::INT AS quantity FROM deck_cards
WHERE deck_id NOT IN (SELECT deck_id FROM saved) AND deck_id NOT IN (SELECT deck_id FROM removed)
UNION ALL
SELECT deck_id::VARCHAR, commander_id, (commander_id % 4 + 1)::INT FROM saved
WHERE commander_id IS NOT NULL AND deck_id NOT IN (SELECT deck_id FROM removed)
UNION ALL
SELECT 'deck-' || sha256(j.user_id || ':' || j.seq), j.commander_id, (j.commander_id % 4 + 1)::INT
FROM judged j JOIN verdicts v ON v.user_id = j.user_id AND v.seq = j.seq
WHERE j.effect = 'create' AND v.accepted AND j.commander_id IS NOT NULL""",
    "deck_creates_refused": _with(*DECK_BASE, EVENTS, DECK_OPS) + """
SELECT user_id, seq FROM verdicts WHERE NOT accepted""",
    "edit_log_replay": _with(CARDS, EVENTS, EDITS) + """
, steps AS (
  SELECT deck_id, card_id, seq, 0 AS part, CASE WHEN op = 'add' THEN 'a' WHEN op = 'remove' THEN 'r' ELSE 'z' END AS what
  FROM live WHERE op IN ('add', 'remove', 'set_commander')
  UNION ALL SELECT deck_id, prev, seq, 1, 'a1' FROM (
    SELECT *, lag(leader) OVER (PARTITION BY deck_id ORDER BY seq) AS prev FROM led)
  WHERE op = 'set_commander' AND prev <> leader)
SELECT deck_id, card_id, q AS quantity FROM (
  SELECT deck_id, card_id, list_reduce(list(code ORDER BY seq, part),
    lambda q, c: CASE c WHEN 1 THEN q + 1 WHEN 2 THEN greatest(q, 1) WHEN 3 THEN greatest(q - 1, 0) ELSE 0 END, 0::BIGINT) AS q
  FROM (SELECT s.*, (CASE WHEN what = 'a' AND c.id IS NOT NULL THEN 1 WHEN what IN ('a', 'a1') THEN 2 WHEN what = 'r' THEN 3 ELSE 4 END)::BIGINT AS code
        FROM steps s LEFT JOIN cards c ON c.id = s.card_id AND c.type_line = 'Basic Land') GROUP BY ALL)
WHERE q > 0""",
    "edit_log_commanders": _with(EVENTS, EDITS) + """
SELECT deck_id, leader AS commander_id FROM (SELECT DISTINCT deck_id FROM edit_log) LEFT JOIN (
  SELECT deck_id, leader, row_number() OVER (PARTITION BY deck_id ORDER BY seq DESC) AS rn FROM led QUALIFY rn = 1) USING (deck_id)""",
    "role_columns": _with(*DECK_BASE, ROLED) + """
SELECT deck_id, primary_role, CASE primary_role WHEN 'Ramp' THEN 2 WHEN 'Card Draw' THEN 3 WHEN 'Removal' THEN 4
  WHEN 'Protection' THEN 6 WHEN 'Utility' THEN 12 WHEN 'Land' THEN 14 ELSE 13 END AS role_order, mana_value, name, quantity
FROM deck_cards JOIN roled ON id = card_id""",
    "role_totals": _with(*DECK_BASE, ROLED) + """
SELECT deck_id, primary_role, CASE primary_role WHEN 'Ramp' THEN 2 WHEN 'Card Draw' THEN 3 WHEN 'Removal' THEN 4
  WHEN 'Protection' THEN 6 WHEN 'Utility' THEN 12 WHEN 'Land' THEN 14 ELSE 13 END AS role_order,
  count(*) AS entries, sum(quantity)::BIGINT AS copies
FROM deck_cards JOIN roled ON id = card_id GROUP BY ALL""",
    "role_histogram": _with(*DECK_BASE, ROLED) + """
SELECT deck_id, count(*) FILTER (primary_role = 'Ramp') AS ramp, count(*) FILTER (primary_role = 'Card Draw') AS card_draw,
  count(*) FILTER (primary_role = 'Removal') AS removal, count(*) FILTER (primary_role = 'Protection') AS protection
FROM deck_cards JOIN roled ON id = card_id GROUP BY deck_id""",
    "deck_validate": _with(*DECK_BASE) + """
, per_deck AS (
  SELECT deck_id, sum(quantity) AS copies, bit_or(ci_mask) AS mask,
    count(*) FILTER (NOT contains(type_line, 'Basic Land') AND quantity > 1) AS repeated
  FROM deck_cards JOIN cards ON id = card_id GROUP BY deck_id),
checks AS (
  SELECT d.id AS deck_id, (coalesce(p.copies, 0) + (d.commander_id IS NOT NULL)::INT)::BIGINT AS deck_size,
    d.commander_id, c.ci_mask AS leader_mask, coalesce(p.mask, 0) AS mask, coalesce(p.repeated, 0) AS repeated
  FROM decks d LEFT JOIN per_deck p ON p.deck_id = d.id LEFT JOIN cards c ON c.id = d.commander_id),
said AS (
  SELECT deck_id, deck_size, concat_ws('; ',
    CASE WHEN deck_size <> 100 THEN 'expected 100 cards, found ' || deck_size END,
    CASE WHEN commander_id IS NULL THEN 'no commander' END,
    CASE WHEN leader_mask IS NULL THEN 'color identity cannot be checked'
         WHEN mask & ~leader_mask <> 0 THEN 'cards outside the commander''s color identity' END,
    CASE WHEN repeated > 0 THEN repeated || ' cards exceed 1 copy' END) AS errors FROM checks)
SELECT deck_id, deck_size, errors = '' AS is_valid, errors FROM said""",
    "identity_violations": _with(*DECK_BASE) + """
SELECT x.deck_id, x.card_id, c.ci_mask & ~l.ci_mask AS extra_mask
FROM deck_cards x JOIN cards c ON c.id = x.card_id JOIN decks d ON d.id = x.deck_id JOIN cards l ON l.id = d.commander_id
WHERE c.ci_mask & ~l.ci_mask <> 0""",
    "card_inclusion": _with(*DECK_BASE) + """
SELECT card_id, count(DISTINCT deck_id) AS n_decks, round(count(DISTINCT deck_id) / (SELECT count(*) FROM decks), 9) AS share
FROM deck_cards GROUP BY card_id""",
    "card_cooccurrence": _with(*DECK_BASE) + """
, led AS (SELECT d.id AS deck_id, commander_id, ci_mask AS lm FROM decks d JOIN cards c ON c.id = commander_id),
pairs AS (SELECT commander_id, card_id, count(*) AS n_decks FROM led JOIN deck_cards USING (deck_id) GROUP BY ALL),
per_leader AS (SELECT commander_id, count(*) AS n FROM led GROUP BY ALL),
eligible AS (SELECT c.ci_mask, count(*) AS n FROM (SELECT DISTINCT ci_mask FROM cards) c JOIN led ON c.ci_mask & ~lm = 0 GROUP BY ALL),
playing AS (SELECT card_id, count(*) AS n FROM led JOIN deck_cards USING (deck_id) JOIN cards c ON c.id = card_id
  WHERE c.ci_mask & ~lm = 0 GROUP BY ALL)
SELECT p.commander_id, p.card_id, p.n_decks, round(p.n_decks / l.n, 9) AS share,
  round(p.n_decks / l.n - coalesce(y.n / e.n, 0), 9) AS synergy
FROM pairs p JOIN per_leader l USING (commander_id) JOIN cards c ON c.id = p.card_id
LEFT JOIN playing y ON y.card_id = p.card_id LEFT JOIN eligible e ON e.ci_mask = c.ci_mask""",
    "identity_union": _with(CARDS, REQUESTS) + "SELECT request_id, wanted_mask, n_context FROM wanted",
    "commander_pick": _with(*GEN_BASE) + """
SELECT request_id, commander_id, identity, CASE WHEN commander_id IS NULL THEN 'no eligible commander' END AS error FROM leaders""",
    "spell_select": _with(*GEN_BASE) + "SELECT request_id, rank, card_id, role FROM spells",
    "nonbasic_select": _with(*GEN_BASE) + "SELECT request_id, rank, card_id FROM nonbasics",
    "basic_split": _with(*GEN_BASE) + "SELECT request_id, color, quantity FROM slots WHERE quantity > 0",
    "deck_generate": _with(*GEN_BASE) + "SELECT request_id, section, rank, card_id, quantity FROM generated",
    "deck_explain": _with(*GEN_BASE) + """
SELECT l.request_id, n.lands_needed, CASE WHEN l.n_context > 0 THEN 'Built around ' || l.names || '. '
    ELSE 'No build-around cards were provided, so a +1/+1 counters shell was chosen. ' END
  || l.commander_name || ' leads the deck: its color identity (' || CASE WHEN l.identity = '' THEN 'colorless' ELSE l.identity END
  || ') covers the strategy and its abilities reinforce the theme. The list runs '
  || coalesce(ramp, 0) || ' ramp, ' || coalesce(draw, 0) || ' draw, ' || coalesce(removal, 0) || ' removal, and '
  || coalesce(protection, 0) || ' protection pieces alongside the synergy package, with ' || n.lands_needed
  || ' lands to keep the curve consistent.' AS explanation
FROM leaders l LEFT JOIN need n USING (request_id) LEFT JOIN (
  SELECT request_id, count(*) FILTER (role = 'Ramp') AS ramp, count(*) FILTER (role = 'Card Draw') AS draw,
    count(*) FILTER (role = 'Removal') AS removal, count(*) FILTER (role = 'Protection') AS protection
  FROM spells GROUP BY request_id) USING (request_id)""",
    "deck_result_split": _with(*GEN_BASE) + """
SELECT g.request_id, section, g.card_id, g.quantity, coalesce(c.quantity, 0) > 0 AS owned, coalesce(c.quantity, 0) <= 0 AS proxy
FROM generated g JOIN requests r USING (request_id)
LEFT JOIN collection c ON c.user_id = r.user_id AND c.card_id = g.card_id""",
    "draft_json_defaults": _with(EVENTS) + """
SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN user_id::VARCHAR END AS deck_id,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'Draft ' || k END AS name,
  CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN k::VARCHAR END AS commander_id,
  CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 2 ELSE 0 END AS n_cards,
  event_type IN ('view', 'error') AS is_empty FROM ev""",
    "draft_card_rows": _with(EVENTS) + """
SELECT event_id, (k + i)::VARCHAR AS card_id, (1 + i)::INT AS quantity
FROM ev, (VALUES (0), (1)) v(i) WHERE event_type IN ('click', 'purchase', 'signup')""",
    "csv_import_resolve": _with(EVENTS, CSV) + """
SELECT user_id, p_partkey AS card_id, sum(quantity)::BIGINT AS quantity FROM csv_judged WHERE reason IS NULL GROUP BY ALL""",
    "csv_import_quarantine": _with(EVENTS, CSV) + "SELECT event_id, reason FROM csv_judged WHERE reason IS NOT NULL",
    "metadata_ingest": _with(METADATA) + """
SELECT card_id, 'Text from ' || source AS summary, stage AS game_stage, round(rating, 6) AS power_rating,
  source || ',' || lang AS roles FROM judged_answers WHERE reason IS NULL""",
    "metadata_quarantine": _with(METADATA, BOUNDED) + "SELECT card_id, reason FROM bounded_answers WHERE reason IS NOT NULL",
    "metadata_tags": """
SELECT doc_id AS card_id, kind, tag FROM documents JOIN (VALUES ('[0-9]{3}', 'theme', 'Numbers'), ('@', 'theme', 'Contact'),
  ('licen[cs]e', 'role', 'License'), ('the ', 'role', 'English'), ('http', 'theme', 'Links')) r(pattern, kind, tag)
  ON regexp_matches(lower(text), pattern)""",
    "knowledge_docs": KNOWLEDGE,
    "retrieval_query": _with(CARDS, ROLED, REQUESTS, RETRIEVAL) + """
, named AS (SELECT request_id, list_sort(list_distinct(flatten(list(CASE split_part(p_name, ' ', 2)
    WHEN 'gear' THEN ['Card Draw', 'Ramp'] WHEN 'rod' THEN ['Oddity', 'Tutor'] ELSE [primary_role] END)))) AS roles
  FROM context JOIN roled ON id = card_id GROUP BY request_id)
SELECT request_id, mask, array_to_string(n.roles, ',') AS roles, array_to_string(themes, ',') AS themes,
  array_to_string(mechanics, ',') AS mechanics, round(list_inner_product(vector, vector), 6) AS vector_norm
FROM asked JOIN named n USING (request_id) LEFT JOIN asked_vectors USING (request_id)""",
    "vector_topk": _with(CARDS, ROLED, REQUESTS, RETRIEVAL) + """
SELECT request_id, rank, card_id, score FROM nearest WHERE rank <= 100""",
    "vector_topk_filtered": _with(CARDS, ROLED, REQUESTS, RETRIEVAL) + """
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, card_id)::INT AS rank, card_id, score
FROM nearest JOIN roled ON id = card_id WHERE mana_value <= 6 AND ci_mask & 19 <> 0
  AND (primary_role IN ('Utility', 'Ramp', 'Oddity') OR split_part(p_name, ' ', 2) = 'gear')
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, card_id) <= 20""",
    "vector_topk_themed": _with(CARDS, ROLED, REQUESTS, RETRIEVAL) + """
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, card_id)::INT AS rank, card_id, score
FROM nearest JOIN cards ON id = card_id WHERE contains(lower(name), 'bolt') AND type_line IN ('Creature', 'Legendary Creature')
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, card_id) <= 5""",
    "synergistic_cards": _with(CARDS, ROLED, REQUESTS, RETRIEVAL) + """
SELECT request_id, rank, card_id, score FROM synergistic""",
    "supporting_cards": _with(CARDS, ROLED, REQUESTS, RETRIEVAL) + "SELECT request_id, card_id, score FROM supporting",
    "candidate_mix": _with(CARDS, ROLED, REQUESTS, RETRIEVAL) + """
SELECT request_id, rank, card_id, score, kinds FROM mixed""",
    "prompt_table": _with(CARDS, ROLED, REQUESTS, RETRIEVAL) + """
, chosen AS (SELECT request_id, string_agg('- ' || name || ' | ' || type_line, chr(10) ORDER BY id) AS lines
  FROM context JOIN cards ON id = card_id GROUP BY request_id),
offered AS (SELECT request_id, string_agg('- ' || name || ' | ' || type_line, chr(10) ORDER BY rank) AS lines
  FROM mixed JOIN cards ON id = card_id GROUP BY request_id)
SELECT request_id, concat_ws(chr(10) || chr(10), 'Build a deck around the selected cards.', 'Power level: ' || power_level,
  'Collection preference: ' || CASE pref WHEN 'strongest' THEN 'Build strongest possible deck'
    WHEN 'prefer' THEN 'Prefer cards I own' ELSE 'Only use my collection' END,
  'Selected cards:' || chr(10) || c.lines, 'Candidate cards:' || chr(10) || o.lines,
  'Rules:' || chr(10) || '- Exactly 100 cards including one commander.' || chr(10) || '- The commander is a legendary creature.'
    || chr(10) || '- Every card stays within the commander''s color identity.' || chr(10)
    || '- One copy of each card except basic lands.') AS prompt
FROM requests LEFT JOIN chosen c USING (request_id) LEFT JOIN offered o USING (request_id)""",
    "response_check": _with(CARDS, EVENTS, RESPONSES) + """
SELECT request_id, attempt, errors, errors = '' AS is_valid FROM checked""",
    "retry_table": _with(CARDS, EVENTS, RESPONSES) + """
SELECT request_id, attempt AS failed_attempt, CASE WHEN attempt < 3 THEN 'retry' ELSE 'exhausted' END AS status, errors,
  CASE WHEN attempt < 3 THEN attempt + 1 END AS attempt,
  CASE WHEN attempt < 3 THEN 'Build deck ' || request_id || chr(10) || chr(10)
  || 'The previous deck broke these rules:' || chr(10) || '- ' || replace(errors, '; ', chr(10) || '- ') END AS prompt
FROM checked WHERE errors <> ''""",
    "upgrade_suggestions": _with(*GEN_BASE, RETRIEVAL) + """
SELECT m.request_id, row_number() OVER (PARTITION BY m.request_id ORDER BY m.score DESC, m.card_id)::INT AS rank, m.card_id, m.score,
  c.card_id IS NOT NULL AS owned
FROM mixed m JOIN requests r ON r.request_id = m.request_id
LEFT JOIN (SELECT DISTINCT request_id, card_id FROM generated) g ON g.request_id = m.request_id AND g.card_id = m.card_id
LEFT JOIN collection c ON c.user_id = r.user_id AND c.card_id = m.card_id AND c.quantity > 0
WHERE g.card_id IS NULL
QUALIFY row_number() OVER (PARTITION BY m.request_id ORDER BY m.score DESC, m.card_id) <= 10""",
    "deck_results": _with(*GEN_BASE) + """
SELECT l.request_id, l.commander_id, coalesce(cards, '') AS cards,
  CASE WHEN l.commander_id IS NULL THEN 'no eligible commander' END AS error
FROM leaders l LEFT JOIN (
  SELECT request_id, string_agg(quantity || 'x' || card_id, ',' ORDER BY
    CASE section WHEN 'spell' THEN 1 WHEN 'land' THEN 2 ELSE 3 END, rank) AS cards
  FROM generated GROUP BY request_id) USING (request_id)""",
    "decks_newest_first": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS updated_at FROM orders",
    "collection_by_color": _with(CARDS, COLLECTION) + """
SELECT user_id, id, name, CASE WHEN contains(type_line, 'Land') THEN 7 WHEN bit_count(ci_mask) > 1 THEN 5
  WHEN ci_mask = 8 THEN 3 ELSE 4 END AS color_key, quantity
FROM cards JOIN collection ON card_id = id WHERE quantity <> 0 AND ci_mask & 24 <> 0""",
    "collection_seed": _with(CARDS) + """
SELECT 'new user' AS user_id, id AS card_id, (mana_value - 4)::INT AS quantity FROM cards WHERE mana_value > 4""",
    "stream_collection": _with(CARDS, EVENTS, ADDS) + """
SELECT user_id, card_id, sum(least(99, greatest(1, quantity)))::BIGINT AS quantity FROM adds
WHERE card_id IN (SELECT id FROM cards) GROUP BY ALL""",
    "stream_decks": _with(EVENTS) + """
, saves AS (
  SELECT coalesce(o_custkey, user_id) AS user_id, event_id AS seq, 'deck of event ' || event_id AS name, k AS commander_id, ts
  FROM (SELECT *, CASE WHEN event_type <> 'signup' THEN user_id * 10 + k % 10 END AS target FROM ev
        WHERE event_type NOT IN ('view', 'error')) LEFT JOIN orders ON o_orderkey = target)
SELECT 'deck-' || sha256(user_id || ':' || seq) AS id, user_id, name, commander_id, ts AS created_at, ts AS updated_at
FROM saves QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) <= 12""",
}
ORACLES["deck_build_loop"] = "WITH RECURSIVE " + ",\n".join((CARDS, EVENTS, LOOP)) + """
SELECT request_id, attempt AS attempts, CASE WHEN errors = '' THEN 'valid' ELSE 'exhausted' END AS status, errors
FROM """ + LOOP_JUDGED.format(rounds="tried") + """ WHERE errors = '' OR attempt = 4"""
ORACLES["deck_build_rounds"] = "WITH RECURSIVE " + ",\n".join((CARDS, EVENTS, LOOP)) + """
SELECT attempt, errors, count(*) AS n_requests FROM """ + LOOP_JUDGED.format(rounds="tried") + """ GROUP BY ALL"""
ORACLES["stream_edits"] = ORACLES["edit_log_replay"]
ORACLES["stream_drafts_folded"] = ORACLES["edit_log_replay"]
ORACLES["stream_draft_commanders"] = ORACLES["edit_log_commanders"] + " WHERE leader IS NOT NULL"
ORACLES["stream_counted_adds"] = ORACLES["collection_upsert"]
ORACLES["card_import"] = _with(CARDS) + """
SELECT id::VARCHAR AS id, oracle_id, name, mana_cost, mana_value, identity, type_line, ci_mask::INT AS ci_mask FROM cards
WHERE type_line <> 'Basic Land'"""
ORACLES["card_import_quarantine"] = _with(CARDS) + """
SELECT 'malformed' AS reason, count(*) AS n_lines FROM cards WHERE type_line = 'Basic Land'"""
ORACLES["card_reload_changes"] = _with(CARDS) + """
SELECT id::VARCHAR AS id, CASE type_line WHEN 'Instant' THEN 'new' ELSE 'changed' END AS change FROM cards
WHERE type_line IN ('Instant', 'Artifact') UNION ALL SELECT 's' || s_suppkey, 'gone' FROM supplier"""
ORACLES["card_role_rows"] = """
SELECT doc_id::VARCHAR AS card_id, 'Text from ' || source AS summary, position::INT AS position, CASE position WHEN 0 THEN 'Text' ELSE lang END AS role,
  CASE WHEN quality = 1 THEN 'Good' ELSE '' END AS themes
FROM documents JOIN labels USING (doc_id), (VALUES (0), (1)) v(position) WHERE doc_id IN (SELECT p_partkey FROM part)"""
ORACLES["metadata_without_cards"] = """
SELECT doc_id::VARCHAR AS card_id FROM documents JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT p_partkey FROM part)"""
ORACLES["tfidf_embed"] = _with(TERMS) + """
SELECT card_id, coalesce(n_used, 0)::INT AS n_used, round(CASE WHEN norm > 0 THEN (top / norm)::FLOAT::DOUBLE ELSE 0 END, 4) AS heaviest
FROM docs LEFT JOIN norms USING (card_id)"""
ORACLES["word_frequencies"] = _with(TERMS) + """
SELECT slot, documents FROM frequencies UNION ALL SELECT -1, count(*) FROM docs"""
ORACLES["vector_records"] = _with(TERMS) + """
SELECT doc_id::VARCHAR AS card_id, 'document ' || doc_id AS name, coalesce(lang, '') AS colors, CASE WHEN quality IS NULL THEN '' ELSE 'Text,' || lang END AS roles,
  CASE WHEN quality = 1 THEN 'Good' ELSE '' END AS themes, n_chars::DOUBLE AS mana_value, 512 AS dims, length(document)::INT AS n_chars
FROM documents JOIN docs ON card_id = doc_id LEFT JOIN labels USING (doc_id)"""
ORACLES["vector_record_changes"] = "SELECT doc_id::VARCHAR AS card_id, 'changed' AS change FROM documents JOIN labels USING (doc_id)"
ORACLES["draft_damaged_fields"] = _with(EVENTS) + """
SELECT event_id, k::VARCHAR AS card_id, CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END::INT AS quantity
FROM ev WHERE event_type NOT IN ('signup', 'error')
UNION ALL SELECT event_id, 'x', 1::INT FROM ev WHERE event_type <> 'error'"""
ORACLES["csv_import_counts"] = _with(EVENTS, CSV) + """
SELECT user_id, count(*) FILTER (reason IS NULL) AS imported, count(*) FILTER (reason IS NOT NULL) AS rejected,
  (SELECT count(*) FROM csv_judged WHERE reason IS NULL) AS all_imported, (SELECT count(*) FROM csv_judged WHERE reason IS NOT NULL) AS all_rejected
FROM csv_judged GROUP BY user_id"""
ORACLES["csv_import_collection"] = _with(COLLECTION, EVENTS, CSV) + """
SELECT user_id, card_id, sum(quantity)::BIGINT AS quantity FROM (
  SELECT * FROM collection UNION ALL SELECT user_id, p_partkey, quantity FROM csv_judged WHERE reason IS NULL) GROUP BY ALL"""


def _places(order: str, only: str) -> str:
    return _with(CARDS, COLLECTION) + f"""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY {order}, id) AS place, id
FROM cards JOIN collection ON card_id = id WHERE quantity <> 0 AND {only}"""


ORACLES["collection_places"] = _places("name", "TRUE")
ORACLES["collection_places_by_value"] = _places("mana_value, name", "(ci_mask & 8 <> 0 OR ci_mask = 0)")
ORACLES["collection_places_by_color"] = _places(
    """CASE WHEN contains(type_line, 'Land') THEN 7 WHEN ci_mask = 0 THEN 6 WHEN bit_count(ci_mask) > 1 THEN 5
  WHEN ci_mask = 1 THEN 0 WHEN ci_mask = 2 THEN 1 WHEN ci_mask = 4 THEN 2 WHEN ci_mask = 8 THEN 3 ELSE 4 END, name""",
    "contains(lower(name), 'ring')",
)
ORACLES["deck_places"] = """
SELECT o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place, o_orderkey AS id FROM orders"""
ORACLES["role_column_places"] = _with(*DECK_BASE, ROLED) + """
SELECT deck_id, primary_role, row_number() OVER (PARTITION BY deck_id, primary_role ORDER BY mana_value, name, id) AS place, card_id
FROM deck_cards JOIN roled ON id = card_id"""
_DECK_LOG = _with(*DECK_BASE, EVENTS, DECK_OPS)
_AFTER = _DECK_LOG + ORACLES["deck_cards_after"][len(_DECK_LOG):].replace("SELECT deck_id::VARCHAR AS deck_id,", ", after_cards AS (SELECT deck_id::VARCHAR AS deck_id,", 1)
ORACLES["deck_store_cards"] = _AFTER + """)
SELECT deck_id, card_id::VARCHAR AS card_id, quantity FROM after_cards"""
ORACLES["deck_store_lists"] = _AFTER + "), after_decks AS (" + ORACLES["deck_upsert_lww"][len(_DECK_LOG):] + """)
SELECT d.id, d.name, count(c.card_id)::INT AS n_entries, coalesce(sum(c.quantity), 0)::BIGINT AS copies
FROM after_decks d LEFT JOIN after_cards c ON c.deck_id = d.id GROUP BY d.id, d.name"""
# A stored deck stands before the log of its number: its commander, then its copies as constants of 100 and more.
_LEADERS = "WHERE op IN ('set_commander', 'remove_commander'))"
_OPENED = EDITS.replace(_LEADERS, _LEADERS[:-1] + """
  UNION ALL SELECT id, -2, 'seat', commander_id FROM decks
  WHERE commander_id IS NOT NULL AND id NOT IN (SELECT deck_id FROM edit_log WHERE op = 'clear'))""")
_STEPS = ORACLES["edit_log_replay"][len(_with(CARDS, EVENTS, EDITS)):].split("\nSELECT deck_id, card_id, q AS quantity")[0]
ORACLES["deck_store_opened"] = _with(*DECK_BASE, EVENTS, _OPENED) + _STEPS + """
SELECT deck_id, card_id, q AS quantity FROM (
  SELECT deck_id, card_id, list_reduce(list(code ORDER BY seq, part), lambda q, c: CASE WHEN c >= 100 THEN c - 100
    WHEN c = 1 THEN q + 1 WHEN c = 2 THEN greatest(q, 1) WHEN c = 3 THEN greatest(q - 1, 0) ELSE 0 END, 0::BIGINT) AS q
  FROM (
    SELECT s.deck_id, s.card_id, s.seq, s.part,
      (CASE WHEN what = 'a' AND c.id IS NOT NULL THEN 1 WHEN what IN ('a', 'a1') THEN 2 WHEN what = 'r' THEN 3 ELSE 4 END)::BIGINT AS code
    FROM steps s LEFT JOIN cards c ON c.id = s.card_id AND c.type_line = 'Basic Land'
    UNION ALL
    SELECT deck_id, card_id, -1, 0, 100 + quantity FROM deck_cards
    WHERE deck_id NOT IN (SELECT deck_id FROM edit_log WHERE op = 'clear')) GROUP BY ALL)
WHERE q > 0"""
ORACLES["collection_stored"] = ORACLES["collection_upsert"]
ORACLES["encoder_embed"] = "WITH docs AS (" + KNOWLEDGE + """)
SELECT card_id, """ + ", ".join(f"length(document) - length(replace(document, '{c}', '')) AS n_{c}" for c in "aeio") + " FROM docs"
ORACLES["stream_deck_cards"] = "SELECT id AS deck_id, commander_id AS card_id, (commander_id % 4 + 1)::INT AS quantity FROM (" + ORACLES["stream_decks"] + ")"
