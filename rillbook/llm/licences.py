"""Licence scans by sentence rules: known sentences become identifiers, and rules match their order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: What a sentence may say the licence of.
_SUBJECT = r"(?:(?:this|the) (?:[a-z0-9]+ ){1,4}(?:is|are) )?"
_LICENSED = _SUBJECT + r"(?:dual )?(?:released|licensed|distributed|available|made available) under (?:the )?(?:terms of the )?"
_FREE = r"(?:[a-z0-9]+ ){1,5}is free software you can redistribute it and or modify it under the terms of the gnu "
#: Licence sentences in normal form, as patterns over lower-case words, and their identifiers; the first that fits counts.
SENTENCES = {
    "spdx-mit": r"spdx license identifier mit",
    "spdx-apache-2": r"spdx license identifier apache 2 0",
    "spdx-bsd-2": r"spdx license identifier bsd 2 clause",
    "spdx-bsd-3": r"spdx license identifier bsd 3 clause",
    "spdx-gpl-2": r"spdx license identifier gpl 2 0(?: only| or later)?",
    "spdx-gpl-3": r"spdx license identifier gpl 3 0(?: only| or later)?",
    "spdx-lgpl": r"spdx license identifier lgpl (?:2 1|3 0)(?: only| or later)?",
    "spdx-agpl-3": r"spdx license identifier agpl 3 0(?: only| or later)?",
    "spdx-mpl-2": r"spdx license identifier mpl 2 0",
    "mit-released": _LICENSED + r"mit licen[cs]e",
    "mit-title": r"(?:the )?mit licen[cs]e(?: mit)?",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*",
    "mit-notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": r"(?:the|this) software is provided (?:by .* )?as is .*",
    "apache-2": _LICENSED + r"apache licen[cs]e(?: version)? 2 0(?: the licen[cs]e)?(?: you may not use this file except in compliance with the licen[cs]e)?",
    "apache-comply": r"you may not use this file except in compliance with the licen[cs]e",
    "apache-copy": r"you may obtain a copy of the licen[cs]e at.*",
    "apache-as-is": r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e.*",
    "gpl-3": _LICENSED + r"gnu general public licen[cs]e version 3(?: or later| only| 0)?",
    "gpl-2": _LICENSED + r"gnu general public licen[cs]e version 2(?: or later| only| 0)?",
    "lgpl-free": _FREE + r"(?:lesser|library) general public licen[cs]e.*",
    "agpl-free": _FREE + r"affero general public licen[cs]e.*",
    "gpl-3-free": _FREE + r"general public licen[cs]e .*version 3.*",
    "gpl-2-free": _FREE + r"general public licen[cs]e .*version 2.*",
    "gpl-free": _FREE + r"general public licen[cs]e.*",
    "gpl-hope": r"(?:[a-z0-9]+ ){1,5}is distributed in the hope that it will be useful but without any warranty.*",
    "lgpl": _LICENSED + r"gnu lesser general public licen[cs]e version (?:2 1|3)(?: or later| 0)?",
    "agpl-3": _LICENSED + r"gnu affero general public licen[cs]e version 3(?: or later| 0)?",
    "mpl-2": r"this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2 0",
    "bsd-use": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*",
    "bsd-name": r"neither the name of .* nor the names of its contributors may be used to endorse or promote products.*",
    "cc-by-nc": _LICENSED + r"(?:a )?(?:cc by nc|creative commons attribution noncommercial)(?: 4 0)?(?: international)?(?: licen[cs]e)?",
    "cc-by-sa": _LICENSED + r"(?:a )?(?:cc by sa|creative commons attribution sharealike)(?: 4 0)?(?: international)?(?: licen[cs]e)?",
    "cc-by": _LICENSED + r"(?:a )?(?:cc by|creative commons attribution)(?: 4 0)?(?: international)?(?: licen[cs]e)?",
    "public-domain": r"(?:this (?:work|file) is|released into|dedicated to) (?:in )?the public domain",
    "all-rights": r"(?:copyright .*)?all rights reserved",
}
#: What every known sentence holds; other texts are not looked at closely.
HINT = r"(?i)licen[cs]e|free software|permission|provided|redistribut|copyright|rights reserved|warranty|public domain|names of its contributors|compliance|applicable law|obtain a copy"


@dataclass(frozen=True)
class Rule:
    """A licence that holds where its sentences stand in this order; other known sentences but ``without`` may lie between."""

    licence: str
    sentences: tuple[str, ...]
    without: str = ""


#: The first rule that matches names the licence; a longer rule comes before its parts.
RULES = (
    Rule("MIT", ("mit-grant", "mit-notice", "as-is")),
    Rule("MIT", ("mit-grant", "mit-notice")),
    Rule("BSD-3-Clause", ("bsd-use", "bsd-name", "as-is")),
    Rule("BSD-2-Clause", ("bsd-use", "as-is"), without="bsd-name"),
    Rule("Apache-2.0", ("apache-2", "apache-comply", "apache-copy", "apache-as-is")),
    Rule("LGPL", ("lgpl-free",)),
    Rule("AGPL-3.0", ("agpl-free",)),
    Rule("GPL-3.0", ("gpl-3-free",)),
    Rule("GPL-2.0", ("gpl-2-free",)),
    Rule("GPL", ("gpl-free",)),
    Rule("MIT", ("spdx-mit",)),
    Rule("Apache-2.0", ("spdx-apache-2",)),
    Rule("BSD-2-Clause", ("spdx-bsd-2",)),
    Rule("BSD-3-Clause", ("spdx-bsd-3",)),
    Rule("GPL-2.0", ("spdx-gpl-2",)),
    Rule("GPL-3.0", ("spdx-gpl-3",)),
    Rule("LGPL", ("spdx-lgpl",)),
    Rule("AGPL-3.0", ("spdx-agpl-3",)),
    Rule("MPL-2.0", ("spdx-mpl-2",)),
    Rule("Apache-2.0", ("apache-2",)),
    Rule("MIT", ("mit-released",)),
    Rule("MIT", ("mit-title",)),
    Rule("AGPL-3.0", ("agpl-3",)),
    Rule("LGPL", ("lgpl",)),
    Rule("GPL-3.0", ("gpl-3",)),
    Rule("GPL-2.0", ("gpl-2",)),
    Rule("MPL-2.0", ("mpl-2",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa",)),
    Rule("CC-BY-4.0", ("cc-by",)),
    Rule("Public-Domain", ("public-domain",)),
    Rule("Proprietary", ("all-rights",)),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Ends of a paragraph: an empty line, or one with nothing but marks of a comment.
PARAGRAPH = r"\n[ \t\r*#/;%-]*\n"
#: Ends of a sentence where lines count, and where a paragraph's lines are joined.
LINE_ENDS, JOINED_ENDS = r"[.!?;:][ \t\r\n]+", r"[.!?][ \t\r\n]+"
_TAG = r"(?i)SPDX-License-Identifier:"


def _normal(sentence: Column) -> Column:
    """ASCII letters in lower case, runs of other ASCII characters but digits as one space."""
    return F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), r"[\x00-/:-@\[-`{-\x7F]+", " "))


def sentences(text: Column) -> Column:
    """Normalised sentences by lines: they end at a line break or at a mark before white space."""
    return F.transform(F.split(F.regexp_replace(text, LINE_ENDS, "\n"), "\n"), _normal)


def joined_sentences(paragraph: Column) -> Column:
    """Normalised sentences of a paragraph whose lines are wrapped: they end at a full stop, '!' or '?' alone."""
    return F.transform(F.split(F.regexp_replace(paragraph, JOINED_ENDS, "\x01"), "\x01"), _normal)


def sentence_id(sentence: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES.items()):
        out = F.when(sentence.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _pattern(rule: Rule) -> str:
    """A rule over identifiers that are each followed by a comma."""
    between = "|".join(n for n in SENTENCES if n != rule.without) if rule.without else "[a-z0-9-]+"
    return "(?:^|,)" + f",(?:(?:{between}),)*?".join(rule.sentences) + ","


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences) of every whole text.

    ``sentence_ids`` are the known sentences by paragraph, comma-joined: first those of its text with the line breaks
    joined, then those that only its single lines give; ``licences`` the distinct
    licences whose rules match, in the order of the rules; both are empty where there are none, as in
    null or empty texts. Repeated rows give repeated results.
    """
    tagged = F.regexp_replace("text", _TAG, "SPDX License Identifier ")
    paragraphs = F.filter(F.split(tagged, PARAGRAPH), lambda p: p.rlike(HINT))

    def ids(parts: Column) -> Column:
        return F.filter(F.transform(F.filter(parts, lambda s: s.rlike(HINT)), sentence_id), lambda s: s.isNotNull())

    def both(p: Column) -> Column:
        pair = F.array(F.struct(ids(joined_sentences(p)).alias("joined"), ids(sentences(p)).alias("lines")))
        return F.transform(pair, lambda x: F.concat(x["joined"], F.filter(x["lines"], lambda s: ~F.array_contains(x["joined"], s))))[0]

    known = F.when(F.col("text").rlike(HINT), F.flatten(F.transform(paragraphs, both)))
    rows = docs.select("doc_id", F.coalesce(known, F.array().cast("array<string>")).alias("known"))
    rows = rows.select("doc_id", F.size("known").cast("bigint").alias("n_sentences"), F.array_join("known", ",").alias("sentence_ids"))
    listed = F.concat("sentence_ids", F.lit(","))
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(listed.rlike(_pattern(r)), r.licence) for r in RULES])))
    return rows.select("doc_id", "n_sentences", "sentence_ids", F.array_join(hits, ",").alias("licences"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The same in DuckDB's SQL."""
    cases = " ".join(f"WHEN regexp_full_match(s, {_quoted(p)}) THEN {_quoted(n)}" for n, p in SENTENCES.items())
    hits = ", ".join(f"CASE WHEN regexp_matches(listed, {_quoted(_pattern(r))}) THEN {_quoted(r.licence)} END" for r in RULES)

    def ids(parts: str) -> str:
        plain = rf"trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[\x00-/:-@\[-`{{-\x7F]+', ' ', 'g'), ' ')"
        return (
            f"list_filter(list_transform(list_filter(list_transform({parts}, lambda s: {plain}), lambda s: regexp_matches(s, {_quoted(HINT)})), "
            f"lambda s: CASE {cases} END), lambda s: s IS NOT NULL)"
        )

    return rf"""
    WITH paragraphs AS (
      SELECT doc_id, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '{_TAG}', 'SPDX License Identifier ', 'g'), '{PARAGRAPH}'),
        lambda p: regexp_matches(p, {_quoted(HINT)})) AS parts FROM documents),
    found AS (
      SELECT doc_id, list_transform(parts, lambda p: {{'joined': {ids("string_split(regexp_replace(p, '" + JOINED_ENDS + "', chr(1), 'g'), chr(1))")},
        'lines': {ids("string_split(regexp_replace(p, '" + LINE_ENDS + "', chr(10), 'g'), chr(10))")}}}) AS parts FROM paragraphs),
    named AS (
      SELECT doc_id, flatten(list_transform(parts, lambda x: list_concat(x.joined, list_filter(x.lines, lambda s: NOT list_contains(x.joined, s))))) AS known
      FROM found),
    ids AS (SELECT doc_id, CAST(len(known) AS BIGINT) AS n_sentences, coalesce(array_to_string(known, ','), '') AS sentence_ids FROM named),
    listed AS (SELECT *, sentence_ids || ',' AS listed FROM ids),
    hits AS (SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS found FROM listed)
    SELECT doc_id, n_sentences, sentence_ids,
      coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS licences
    FROM hits"""
