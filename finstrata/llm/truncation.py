"""Texts cut off by field limits or in transfer.

Method, in SQL: every word trigram of the corpus is counted where it stands inside a line and where it
ends a line or a text; the final trigrams of the texts are joined with those counts. A final trigram
that goes on far more often than it ends marks a text that breaks off. Words are split at white space and
keep their punctuation, numbers count as one word, two marks before each line make its start visible, and
trigrams up to SHORT words into a line are counted apart from later ones, as headings, list entries and signatures are
short. A word that others begin with is also counted where it is their beginning: a piece of a word ends nowhere else.

Where a trigram is too rare to tell, the same counts are taken one level up: of the trigram with
capitalised words masked, of its last two words, of its last word. In front of those stands, for a last line of up to SHORT
words, the line itself as one long n-gram, as it is and masked (with a full stop only masked: a company's name that signs a text begins many sentences). Every level counts ends as it counts the rest. Only where
no level has support a break sign decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from finstrata.session import cut_lineage

#: Occurrences, besides the text's own end, from which a level is trusted.
SUPPORT = 5
#: The same for an end with a full stop, which mostly ends a sentence.
SUPPORT_STOP = 80
#: Share of occurrences that are ends, below which a trigram counts as almost never terminal.
ALMOST_NEVER, ALMOST_NEVER_STOP = 0.05, 0.02
#: Words up to which a place in a line counts as near its start.
SHORT = 8
#: Finals that hold at least one in so many texts are looked up in a table sent to every executor; there are at most as many of them.
HOT = 1000

# Signs put where a text breaks off, and what a broken byte sequence leaves; written backwards, to be read from the text's end.
SIGN_BACKWARDS = r"^(?:[\s\p{Z}​﻿]|…|\.{3,}|\](?:…|\.{2,}|tuc|detacnurt)\[|\)(?:…|\.{2,}|tuc|detacnurt)\(|\x{fffd})++"
#: Sentence end: full stop, question or exclamation mark, then closing quotes or brackets.
SENTENCE_END = r"[.!?][\"'“”’»)\]]*$"
_BLANK = r"[\s\p{Z}]+"
_ARGS = {
    "backwards": SIGN_BACKWARDS, "blank": _BLANK, "empty": rf"^(?:{_BLANK})?$", "stop": SENTENCE_END, "shown": r"[^\s\p{Z}​﻿]", "inner": r"^[\p{L}\p{N}]{2}$", "short": SHORT,
    # lines wrapped inside a sentence, and quoted lines
    "wrapped": r"(?<![.!?:|\n])\n(?:> ?)?(?=\p{Ll}(?!\)))|\n> ?",
    # a comma behind a last number is a part of it
    "number": r"\d++(?:[.,]\d++)*+(?:,\z)?+",
    "bullet": r"^(?:[-–—•*·]|\p{Ll}\)|0[.)]|\[0\]) +",
    "names": r"(?<![\p{L}\p{M}])\p{Lu}[\p{L}\p{M}-]*+(?: \p{Lu}[\p{L}\p{M}-]*+)*+",
    "support": SUPPORT, "support_stop": SUPPORT_STOP, "never": ALMOST_NEVER, "never_stop": ALMOST_NEVER_STOP, "hot": HOT,
}

#: The lines of each text that isn't null, empty or blank, without a break sign at its end.
_LINES = """
SELECT doc_id, source, copy, n_chars, regexp_like(sign, :shown) AS signed,
  filter(transform(split(regexp_replace(regexp_replace(regexp_replace(left(text, n_chars - length(sign)), '\\r\\n?', '\\n'), :wrapped, ' '), :number, '0'), '\\n'),
    x -> regexp_replace(trim(regexp_replace(x, :blank, ' ')), :bullet, '• ')), x -> x <> '') AS lines
FROM (SELECT doc_id, source, text, xxhash64(text) AS copy, length(text) AS n_chars, regexp_extract(reverse(text), :backwards, 0) AS sign FROM {documents} WHERE NOT regexp_like(text, :empty))
"""

#: The words of a line r and of the same with names masked b, two marks in front of either.
_WORDS = "concat(array('⏎', '⏎'), split(line, ' ')) AS r, concat(array('⏎', '⏎'), split(regexp_replace(line, :names, 'X'), ' ')) AS b"

#: How often each n-gram goes on and ends inside texts, their last ends left out. level 0: a line of up to :short words as (⏎⏎, all but the last word, last word), 2: trigrams, 3: trigrams with names masked.
_COUNTS = """
WITH all_lines AS (SELECT at < size(lines) - 1 AS whole, WORDS FROM (SELECT lines, posexplode(lines) AS (at, line) FROM {lines})),
grams AS (
  SELECT whole, level, inline(arrays_zip(k, rest, w1, w2, w3))
  FROM (
    SELECT whole, level, sequence(1, size(w) - 2) AS k, sequence(size(w) - 3, 0, -1) AS rest, slice(w, 1, size(w) - 2) AS w1, slice(w, 2, size(w) - 2) AS w2, slice(w, 3, size(w) - 2) AS w3
    FROM (SELECT whole, 2 AS level, r AS w FROM all_lines UNION ALL SELECT whole, 3, b FROM all_lines))
  UNION ALL
  SELECT whole, 0, k, size(r) - 2 - k, '⏎⏎', array_join(slice(r, 3, k - 1), ' '), r[k + 1] FROM (SELECT whole, r, explode(sequence(1, least(size(r) - 2, :short))) AS k FROM all_lines))
SELECT level, k > :short AS far, w1, w2, w3, sum(IF(rest > 0, 1, 0)) AS n_in, sum(IF(rest > 0, 0, 1)) AS n_end
FROM grams
WHERE rest > 0 OR whole
GROUP BY level, k > :short, w1, w2, w3
""".replace("WORDS", _WORDS)

#: The last n-gram of each text at the levels 0, 2 and 3; those of the same n-grams share `final`.
_FINALS = """
SELECT *, xxhash64(opening, trigram, masked) AS final, trigram.w3 = '' OR regexp_like(trigram.w3, :stop) AS stop
FROM (
  SELECT doc_id, source, copy, n_chars, signed,
    IF(size(r) <= 2 + :short, struct(false AS far, '⏎⏎' AS w1, array_join(slice(r, 3, size(r) - 3), ' ') AS w2, r[size(r) - 1] AS w3), NULL) AS opening,
    struct(size(r) > 2 + :short AS far, r[size(r) - 3] AS w1, r[size(r) - 2] AS w2, r[size(r) - 1] AS w3) AS trigram,
    struct(size(b) > 2 + :short AS far, b[size(b) - 3] AS w1, b[size(b) - 2] AS w2, b[size(b) - 1] AS w3) AS masked
  FROM (SELECT *, WORDS FROM (SELECT *, lines[size(lines) - 1] AS line FROM {lines} WHERE size(lines) > 0)))
""".replace("WORDS", _WORDS)

#: The n-grams of both, the ends of copies counted once; asked: a text ends so.
_EVERY = """
WITH ends AS (
  SELECT level, x.*, 0 AS n_in, count(*) AS n_end, 1 AS asked
  FROM (SELECT inline(array(struct(0 AS level, opening AS x), struct(2 AS level, trigram AS x), struct(3 AS level, masked AS x))) FROM (SELECT DISTINCT copy, opening, trigram, masked FROM {finals}))
  WHERE x IS NOT NULL GROUP BY level, x)
SELECT level, far, w1, w2, w3, sum(n_in) AS n_in, sum(n_end) AS n_end, max(asked) AS asked
FROM (SELECT *, 0 AS asked FROM {counts} UNION ALL SELECT level, far, w1, w2, w3, n_in, n_end, asked FROM ends)
GROUP BY level, far, w1, w2, w3
"""

#: All levels. 1: lines up to :short words with names masked, counted in different lines, so that one frequent line vouches for no other; 4: last two words, 5: last word of level 3.
_LEVELS = """
SELECT level, far, w1, w2, w3, n_in, n_end, asked FROM {every}
UNION ALL
SELECT 1, false, '⏎⏎', left(m, length(m) - length(substring_index(m, ' ', -1))), substring_index(m, ' ', -1), sum(IF(n_in > 0, 1, 0)), sum(IF(n_end > 0, 1, 0)), max(asked)
FROM (SELECT regexp_replace(trim(concat_ws(' ', w2, w3)), :names, 'X') AS m, n_in, n_end, asked FROM {every} WHERE level = 0) GROUP BY m
UNION ALL
SELECT 4, far, '', w2, w3, sum(n_in), sum(n_end), max(asked) FROM {every} WHERE level = 3 GROUP BY far, w2, w3
UNION ALL
SELECT 5, far, '', '', w3, sum(n_in), sum(n_end), max(asked) FROM {every} WHERE level = 3 GROUP BY far, w3
"""

#: n_longer: how often an asked n-gram's last word is the beginning of a longer one in the same place that goes on, or inside whose letters it ends. Only beginnings as long as one that is asked for there are made.
_STATS = """
WITH lengths AS (SELECT level, far, w1, w2, collect_set(length(w3)) AS ks FROM {levels} WHERE asked = 1 GROUP BY level, far, w1, w2),
longer AS (
  SELECT level, far, w1, w2, left(w3, k) AS w3, sum(n_in + IF(substr(w3, k, 2) RLIKE :inner, n_end, 0)) AS n
  FROM (SELECT level, far, w1, w2, w3, n_in, n_end, explode(filter(ks, k -> k < length(w3))) AS k FROM {levels} JOIN lengths USING (level, far, w1, w2))
  GROUP BY level, far, w1, w2, left(w3, k))
SELECT xxhash64(level, far, w1, w2, w3) AS h, level, max(n_in) AS n_in, max(n_end) AS n_end, max(n) AS n_longer
FROM (
  SELECT level, far, w1, w2, w3, n_in, n_end, 0 AS n FROM {levels} WHERE asked = 1
  UNION ALL SELECT level, far, w1, w2, w3, 0, 0, n FROM longer)
GROUP BY level, far, w1, w2, w3
HAVING max(n_end) > 0
"""

#: Each different final with the counts of all its levels, and the verdict by the first level that has support, or else by the last; open: none has.
_DECIDED = """
WITH kinds AS (
  SELECT final, first(opening) AS opening, first(trigram) AS trigram, first(masked) AS masked, first(stop) AS stop, count(*) AS n FROM {finals} GROUP BY final),
asked AS (
  SELECT final, stop, n, explode(filter(array(
    IF(opening IS NULL, NULL, xxhash64(0, opening.far, opening.w1, opening.w2, opening.w3)),
    IF(opening IS NULL, NULL, xxhash64(1, false, '⏎⏎', left(m, length(m) - length(substring_index(m, ' ', -1))), substring_index(m, ' ', -1))),
    xxhash64(2, trigram.far, trigram.w1, trigram.w2, trigram.w3), xxhash64(3, masked.far, masked.w1, masked.w2, masked.w3),
    xxhash64(4, masked.far, '', masked.w2, masked.w3), xxhash64(5, masked.far, '', '', masked.w3)), x -> x IS NOT NULL)) AS h
  FROM (SELECT *, regexp_replace(trim(concat_ws(' ', opening.w2, opening.w3)), :names, 'X') AS m FROM kinds)),
told AS (
  SELECT final, first(stop) AS stop, first(n) AS n, array_sort(collect_list(struct(s.level, s.n_in + s.n_longer AS n_in, s.n_end))) AS levels
  FROM asked JOIN {stats} s USING (h) GROUP BY final),
-- without the text's own end; of the lines counted at level 1 it is one only if no other text ends with it
others AS (SELECT final, stop, n, transform(levels, x -> struct(x.level, x.n_in, x.n_end - IF(x.level = 1 AND levels[0].n_end > 1, 0, 1) AS n_end)) AS levels FROM told),
best AS (SELECT *, coalesce(try_element_at(filter(levels, x -> x.n_in + x.n_end >= IF(stop, :support_stop, :support) AND NOT (stop AND x.level = 0)), 1), element_at(levels, -1)) AS s FROM others)
SELECT final, n, s.level, s.n_in, s.n_end, s.n_in + s.n_end < IF(stop, :support_stop, :support) AS open,
  IF(stop, s.n_in + s.n_end >= :support_stop AND s.n_end < :never_stop * (s.n_in + s.n_end), s.n_end < :never * (s.n_in + s.n_end)) AS truncated
FROM best
"""

_JUDGED = """
WITH hot AS (SELECT * FROM {decided} WHERE n * :hot >= (SELECT count(*) FROM {finals}))
SELECT /*+ BROADCAST(h) */ f.doc_id, f.source, f.copy, f.n_chars, f.signed, f.stop, f.trigram, h.level, h.n_in, h.n_end, h.truncated OR (h.open AND f.signed AND NOT f.stop) AS truncated FROM {finals} f JOIN hot h USING (final)
UNION ALL
SELECT f.doc_id, f.source, f.copy, f.n_chars, f.signed, f.stop, f.trigram, d.level, d.n_in, d.n_end, d.truncated OR (d.open AND f.signed AND NOT f.stop)
FROM (SELECT /*+ BROADCAST(h) */ f.* FROM {finals} f LEFT ANTI JOIN hot h USING (final)) f JOIN {decided} d USING (final)
"""


def _sql(like: DataFrame, query: str, **frames: DataFrame) -> DataFrame:
    return like.sparkSession.sql(query, args={k: v for k, v in _ARGS.items() if f":{k}" in query}, **frames)


def judge(documents: DataFrame) -> DataFrame:
    """(doc_id, source, copy, n_chars, signed, stop, trigram, level, n_in, n_end, truncated) of each text with a word.

    trigram is the final one; n_in and n_end are how often it goes on and ends elsewhere, at the level (0 to 5, see
    `_COUNTS` and `_LEVELS`) that decided; signed: a break sign stands behind it; stop: it has a full stop.
    Null, empty and blank texts give no row; copies count as one text where ends are counted, and
    have a row each. Other columns are ignored.
    """
    lines = cut_lineage(_sql(documents, _LINES, documents=documents.select("doc_id", "source", "text")))  # read twice; normalising costs more than a copy
    finals = cut_lineage(_sql(documents, _FINALS, lines=lines))
    every = cut_lineage(_sql(documents, _EVERY, counts=_sql(documents, _COUNTS, lines=lines), finals=finals))
    stats = _sql(documents, _STATS, levels=_sql(documents, _LEVELS, every=every))
    decided = cut_lineage(_sql(documents, _DECIDED, finals=finals, stats=stats))
    return _sql(documents, _JUDGED, finals=finals, decided=decided)


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id): the documents whose text breaks off inside a word or sentence; repeated rows once."""
    return judge(documents).filter("truncated").select("doc_id").distinct()


def sources(documents: DataFrame) -> DataFrame:
    """(source, texts, cut, signed, share, cut_at): how often each source cuts, how many cut texts have a break sign and their commonest length."""
    return _sql(
        documents,
        """SELECT source, count(*) AS texts, count_if(truncated) AS cut, count_if(truncated AND signed) AS signed, count_if(truncated) / count(*) AS share,
             mode(IF(truncated, n_chars, NULL), true) AS cut_at FROM {judged} GROUP BY source""",
        judged=judge(documents),
    )
