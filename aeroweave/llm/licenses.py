"""License scan by ordered signature rules, in DataFrame operations only.

A text becomes its words, each with a space before and after it, so a rule is a regular expression that
starts and ends at word borders and needs no look-around. Every rule is asked for by a word that its phrase
cannot do without; a cheap search for these words lets most texts go, and on the rest only the rules whose
word is there are tried. Detections are
word intervals. One that lies inside another of the same or a higher priority is suppressed: a running
maximum of interval ends, in order of starts, finds that without comparing pairs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, cut

# Phrases whose places are counted, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Word characters are all but these; A-Z count as a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: label; keyword; name in words ("?" behind a word: it may be missing); versions
FAMILIES = (
    ("apache", "apache", "apache software? foundation?", ("1 0", "1 1", "2 0", "2")),
    ("mit", "mit", "mit x11?", ()),
    ("bsd", "bsd", "(new|modified|simplified|revised|original)? (2|3|4|two|three|four)? clause? bsd style?", ()),
    ("gpl", "gpl", "gnu? gpl", ("1", "2", "2 0", "3", "3 0")),
    ("gpl", "general", "gnu? general public license", ("1", "2", "2 0", "3", "3 0")),
    ("lgpl", "lgpl", "gnu? lgpl", ("2", "2 0", "2 1", "3", "3 0")),
    ("lgpl", "lesser", "gnu? lesser general public license", ("2", "2 0", "2 1", "3", "3 0")),
    ("lgpl", "library", "gnu? library general public license", ("2", "2 0")),
    ("agpl", "agpl", "gnu? agpl", ("3", "3 0")),
    ("agpl", "affero", "gnu? affero general public license", ("1", "3", "3 0")),
    ("gfdl", "documentation", "gnu? free documentation license", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla", "mozilla public license", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public license", ("1 0", "2 0")),
    ("cddl", "cddl", "cddl", ("1 0", "1 1")),
    ("cddl", "distribution", "common development and distribution license", ("1 0", "1 1")),
    ("artistic", "artistic", "perl? artistic", ("1 0", "2 0")),
    ("boost", "boost", "boost software?", ("1 0",)),
    ("isc", "isc", "isc", ()),
    ("zlib", "zlib", "zlib libpng?", ()),
    ("unlicense", "unlicense", "the? unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("eupl", "eupl", "eupl", ("1 1", "1 2")),
    ("eupl", "european", "european union public licen[cs]e", ("1 1", "1 2")),
    ("python", "python", "python software foundation", ("2",)),
    ("ofl", "font", "sil? open font", ("1 0", "1 1")),
    ("odbl", "database", "open data commons? open? database", ("1 0",)),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc-by", "cc", "cc by", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc", "cc by sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", "cc by nc", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", "cc by nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative", "creative commons attribution", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "creative", "creative commons attribution no ?derivs", ("2 0", "2 5", "3 0", "4 0")),
)

#: notice around a name; priority; confidence
NOTICES = (
    ("(licensed|released|published|available|distributed|provided) (under|with) (the|a|an)? {} (license|licence)?", 2, 0.85),
    ("(under|per|to) the? terms (and conditions)? of the? {}", 2, 0.85),
    ("(redistribute|modify|use|copy) it under the? {}", 2, 0.85),
    ("(covered|governed) by the? {}", 2, 0.8),
    ("(see|read) the? {} (license|licence)? for (more|further)? details?", 2, 0.8),
    ("spdx license identifier {}", 4, 0.99),
)
VERSIONED = (
    ("(licensed|released|published|available|distributed|provided) (under|with) (the|a|an)? {} (license|licence)? (version|v)? {v}", 3, 0.95),
    ("{} (license|licence)? (version|v)? {v} (only|or later)?", 2, 0.9),
    ("spdx license identifier {} {v}", 4, 0.99),
)
#: label; keyword; phrase; priority; confidence
STANDALONE = (
    ("public-domain", "domain", "(dedicated|released|placed) (to|into|in) the public domain", 3, 0.9),
    ("public-domain", "domain", "public domain", 1, 0.5),
    ("reserved", "rights", "all rights reserved", 1, 0.6),
    ("reserved", "rights", "(no part|any part) of this (work|publication|document) may be reproduced", 2, 0.8),
    ("copyright", "copyright", "copyright c? [12][90][0-9][0-9]", 1, 0.5),
    ("copyleft", "copyleft", "copyleft", 1, 0.5),
    ("no-warranty", "warranty", "(without|absolutely no) (any|express|implied)? warranty", 1, 0.5),
    ("no-warranty", "warranty", "provided as is without warranty of any kind", 2, 0.7),
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 3, 0.95),
    ("isc", "granted", "permission to use copy modify and or distribute this software", 3, 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms", 3, 0.95),
    ("gpl", "general", "general public license", 1, 0.6),
    ("cc-by", "cc", "cc by", 1, 0.6),
)
PRIORITIES = (1, 2, 3, 4)


def pattern(phrase: str) -> str:
    """A rule's regular expression: each word stands between its own spaces."""
    out, depth, group = [], 0, ""
    for token in phrase.split():
        group = f"{group} {token}" if depth else token
        depth += token.count("(") - token.count(")")
        if depth:
            continue
        may_miss = group.endswith("?") and not group.endswith("\\?")
        body = group[:-1] if may_miss else group
        if body.startswith("("):
            options = "|".join(" " + "  ".join(o.split()) + " " for o in body.strip("()").split("|")) if " " not in body or "|" in body or body[0] == "(" else body
            body = f"(?:{options})"
        elif body.startswith("?"):
            raise ValueError("a join mark belongs to the word before")
        else:
            body = f" {body} "
        out.append(f"(?:{body})?" if may_miss else body)
    return "".join(out)


def _expanded(name: str) -> list[str]:
    """"share ?alike" stands for one word and for two."""
    if " ?" not in name:
        return [name]
    return [name.replace(" ?", " "), name.replace(" ?", "")]


def rules() -> list[tuple[int, str, str, int, float, str]]:
    """(rule_id, label, keyword, priority, confidence, regular expression), in order of rule_id."""
    out: list[tuple[str, str, int, float, str]] = []
    for label, keyword, name, versions in FAMILIES:
        for form in _expanded(name):
            for notice, priority, confidence in NOTICES:
                out.append((label, keyword, priority, confidence, notice.replace("{}", form)))
            whole = form.endswith(("license", "licen[cs]e"))  # such a name is a detection by itself
            out.append((label, keyword, 1, 0.6, form if whole else f"{form} (license|licence)"))
            choice = "|".join(sorted(versions, key=lambda v: (-len(v), v)))
            if versions:
                for notice, priority, confidence in VERSIONED:
                    out.append((label, keyword, priority, confidence, notice.replace("{}", form).replace("{v}", f"({choice})")))
    out += [(label, keyword, priority, confidence, phrase) for label, keyword, phrase, priority, confidence in STANDALONE]
    return [(i, label, keyword, priority, confidence, pattern(phrase)) for i, (label, keyword, priority, confidence, phrase) in enumerate(out)]


def sure_words(regex: str) -> list[str]:
    """The words that stand in every text of a rule, in order."""
    while (left := re.sub(r"\(\?:[^()]*\)\??", " ", regex)) != regex:
        regex = left
    return [w for w in regex.split() if w.isalnum()]


def asked_rules() -> list[tuple[int, str, str, int, float, str]]:
    """The rules; where the keyword need not stand in the phrase, the longest word that must takes its place."""
    out = []
    for i, label, keyword, priority, confidence, regex in rules():
        words = sure_words(regex)
        out.append((i, label, keyword if keyword in words else max(words, key=len), priority, confidence, regex))
    return out


def keywords() -> list[str]:
    """A text without any of these words has no place of a rule and none of a base phrase."""
    return sorted({r[2] for r in asked_rules()})  # the base phrases are rules too


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _norm(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(low, NOT_WORD, " "))
    return F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))


def scanned(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_words and, where a keyword is found as a word, norm. A written table with one row a document."""
    rows = columns(docs, doc_id=T.LongType(), text=T.StringType()).withColumn("text", F.coalesce("text", F.lit("")))
    low = F.lower("text")  # finds at least what A-Z in lower case finds
    gate = F.lit(False)
    for word in keywords():
        gate = gate | F.contains(low, F.lit(word))
    n_words = F.regexp_count("text", F.lit(IS_WORD)).cast("long")
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", n_words.alias("n_words"), F.when(gate, F.col("text")).alias("some"))
    rows = rows.select("rid", "doc_id", "n_words", "some", F.col("some").rlike(rf"(?i)(?:^|{NOT_WORD[:-1]})(?:{'|'.join(keywords())})(?:{NOT_WORD[:-1]}|$)").alias("look"))
    return cut(rows.select("rid", "doc_id", "n_words", F.when(F.col("look"), _norm(F.col("some"))).alias("norm")), "scanned")


def base_places(scan: DataFrame) -> DataFrame:
    """Adds n_base, first_word, last_word, base (array of labels) to the scan."""
    total = F.lit(0).cast("long")
    firsts, lasts, labels = [], [], []
    for phrase, label in BASE:
        spaced = F.lit(" " + "  ".join(phrase.split()) + " ")
        pieces = F.split("norm", spaced)
        n = F.coalesce(F.size(pieces).cast("long") - 1, F.lit(0).cast("long"))
        n = F.when(F.col("norm").isNull(), F.lit(0).cast("long")).otherwise(n)
        found = n > 0
        total = total + n
        firsts.append(F.when(found, (_spaces(F.element_at(pieces, 1)) / 2).cast("long")))
        lasts.append(F.when(found, F.col("n_words") - (_spaces(F.element_at(pieces, -1)) / 2).cast("long") - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    return scan.select("*", total.alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("base"))


def detections(scan: DataFrame) -> DataFrame:
    """All places of all rules: rid, rule_id, label, priority, confidence, first, last (words from 0, inclusive)."""
    spark = scan.sparkSession
    table = spark.createDataFrame(asked_rules(), "rule_id int, label string, keyword string, priority int, confidence double, pattern string")
    texts = scan.where("norm is not null").select("rid", "norm")
    keys = F.array(*map(F.lit, keywords()))
    asked = texts.select("rid", "norm", F.explode(F.filter(keys, lambda k: F.contains(F.col("norm"), F.concat(F.lit(" "), k, F.lit(" "))))).alias("keyword"))
    tried = asked.join(F.broadcast(table), "keyword").where("norm rlike pattern")  # the rules are a constant of this module
    places = tried.select("rid", "rule_id", "label", "priority", "confidence", F.split("norm", F.col("pattern")).alias("pieces"), F.expr("regexp_extract_all(norm, pattern, 0)").alias("found"))
    pairs = F.arrays_zip(F.slice("pieces", F.lit(1), F.size("found")).alias("piece"), F.col("found"))
    each = places.select("rid", "rule_id", "label", "priority", "confidence", F.posexplode(pairs).alias("k", "p"))
    gap, size = (_spaces(F.col("p.piece")) / 2).cast("long"), (_spaces(F.col("p.found")) / 2).cast("long")
    order = Window.partitionBy("rid", "rule_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(gap + size).over(order)
    return each.select("rid", "rule_id", "label", "priority", "confidence", (end - size).alias("first"), (end - 1).alias("last"))


def survivors(found: DataFrame) -> DataFrame:
    """Detections not inside another of the same or a higher priority; of equal intervals the first rule's stays."""
    order = Window.partitionBy("rid").orderBy("first", F.col("last").desc(), F.col("priority").desc(), "rule_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = {p: F.max(F.when(F.col("priority") >= p, F.col("last"))).over(order) for p in PRIORITIES}
    flagged = found.withColumns({f"end{p}": e for p, e in ends.items()})
    covering = F.coalesce(*[F.when(F.col("priority") == p, F.col(f"end{p}")) for p in PRIORITIES])
    return flagged.where(covering.isNull() | (covering < F.col("last"))).select(*found.columns)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no labels; the score is the highest confidence among the detections
    that stay, 0 without any. Repeated rows each get a row; extra columns are ignored; an empty table gives
    no rows.
    """
    scan = scanned(docs)
    base = base_places(scan)
    kept = survivors(detections(scan)).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("confidence").alias("score"))
    rows = base.drop("norm").join(kept, "rid", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


# The same in DuckDB: chr() writes no control characters into the SQL text.
def duckdb_sql() -> str:
    values = ",\n".join(f"({i},'{label}','{keyword}',{priority},{confidence}::double,'{regex}')" for i, label, keyword, priority, confidence, regex in rules())
    base = []
    for phrase, label in BASE:
        spaced = " " + "  ".join(phrase.split()) + " "
        base.append((spaced, label, len(phrase.split())))
    n = " + ".join(f"len(string_split(norm, '{s}')) - 1" for s, _, _ in base)
    first = "least(" + ", ".join(f"case when contains(norm, '{s}') then (length(string_split(norm, '{s}')[1]) - length(replace(string_split(norm, '{s}')[1], ' ', ''))) // 2 end" for s, _, _ in base) + ")"
    last = "greatest(" + ", ".join(f"case when contains(norm, '{s}') then n_words - (length(string_split(norm, '{s}')[-1]) - length(replace(string_split(norm, '{s}')[-1], ' ', ''))) // 2 - {w} end" for s, _, w in base) + ")"
    labels = ", ".join(f"case when contains(norm, '{s}') then '{label}' end" for s, label, _ in base)
    ends = ", ".join(f"max(case when priority >= {p} then last end) over w as end{p}" for p in PRIORITIES)
    covering = " ".join(f"when {p} then end{p}" for p in PRIORITIES)
    return rf"""
with rules(rule_id, label, keyword, priority, confidence, pattern) as (values
{values}),
docs as (select row_number() over () as rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
words as (select rid, doc_id, len(list_filter(string_split_regex(low, '{NOT_WORD}'), lambda w: w <> '')) as n_words,
  ' ' || replace(trim(regexp_replace(low, '{NOT_WORD}', ' ', 'g'), ' '), ' ', '  ') || ' ' as norm from docs),
tried as (select rid, rule_id, label, priority, confidence, string_split_regex(norm, pattern) as pieces, regexp_extract_all(norm, pattern) as found
  from words join rules on contains(norm, keyword) and regexp_matches(norm, pattern)),
each as (select rid, rule_id, label, priority, confidence, unnest(range(1, len(found) + 1)) as k, pieces, found from tried),
sized as (select *, (length(pieces[k]) - length(replace(pieces[k], ' ', ''))) // 2 as gap, (length(found[k]) - length(replace(found[k], ' ', ''))) // 2 as size from each),
placed as (select rid, rule_id, label, priority, confidence, size, sum(gap + size) over (partition by rid, rule_id order by k) as e from sized),
detected as (select rid, rule_id, label, priority, confidence, e - size as first, e - 1 as last from placed),
flagged as (select *, {ends} from detected window w as (partition by rid order by first, last desc, priority desc, rule_id rows between unbounded preceding and 1 preceding)),
kept as (select rid, list(distinct label) as more, max(confidence) as score from flagged
  where coalesce(case priority {covering} end, -1) < last group by rid),
base as (select *, {n} as n_base, {first} as first_word, {last} as last_word, list_filter([{labels}], lambda x: x is not null) as base from words)
select doc_id, n_words::bigint as n_words, n_base::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  array_to_string(list_sort(base), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, []::varchar[])))), ',') as labels,
  coalesce(score, 0)::double as score
from base left join kept using (rid)"""
