"""Licences recognised from sequences of known sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.shared import whole

# Known licence sentences, normalised, and their identifiers. Version numbers read #.
SENTENCES = {
    "licensed under the apache license version #": "apache-notice",
    "licensed under the apache license version # the license": "apache-notice",
    "this file is licensed under the apache license version #": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at http www apache org licenses license #": "apache-copy",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software":
        "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "this work is licensed under the gnu general public license version #": "gpl-notice",
    "licensed under the gnu general public license version #": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version # of the license or at your option any later version":
        "gpl-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under the gnu lesser general public license version #": "lgpl-notice",
    "licensed under the gnu affero general public license version #": "agpl-notice",
    "licensed under the mozilla public license version #": "mpl-notice",
    "this source code form is subject to the terms of the mozilla public license v #": "mpl-notice",
    "released under the bsd # clause license": "bsd-notice",
    "licensed under the bsd # clause license": "bsd-notice",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer":
        "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "licensed under cc by #": "cc-by",
    "licensed under cc by sa #": "cc-by-sa",
    "licensed under cc by nc #": "cc-by-nc",
    "licensed under cc by nd #": "cc-by-nd",
    "licensed under cc by nc sa #": "cc-by-nc-sa",
    "licensed under cc by nc nd #": "cc-by-nc-nd",
    "released under the isc license": "isc-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
}
# Licence rules in the order they are tried, each a sequence of identifiers; @ is the version of its first one.
RULES = [
    ("GPL-@-or-later", ["gpl-or-later", "gpl-warranty"]),
    ("Apache-@", ["apache-notice", "apache-compliance", "apache-copy"]),
    ("Apache-@", ["apache-notice", "apache-compliance"]),
    ("MIT", ["mit-notice", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-condition", "mit-warranty"]),
    ("BSD", ["bsd-source", "bsd-binary"]),
    ("GPL-@-or-later", ["gpl-or-later"]),
    ("Apache-@", ["apache-notice"]),
    ("MIT", ["mit-notice"]),
    ("GPL-@", ["gpl-notice"]),
    ("LGPL-@", ["lgpl-notice"]),
    ("AGPL-@", ["agpl-notice"]),
    ("MPL-@", ["mpl-notice"]),
    ("BSD-@-Clause", ["bsd-notice"]),
    ("CC-BY-@", ["cc-by"]),
    ("CC-BY-SA-@", ["cc-by-sa"]),
    ("CC-BY-NC-@", ["cc-by-nc"]),
    ("CC-BY-ND-@", ["cc-by-nd"]),
    ("CC-BY-NC-SA-@", ["cc-by-nc-sa"]),
    ("CC-BY-NC-ND-@", ["cc-by-nc-nd"]),
    ("ISC", ["isc-notice"]),
    ("Unlicense", ["unlicense-grant"]),
]
# Where sentences end, what a version looks like, what is no word.
SENTENCE_END = r"[.!?;:]+([^0-9A-Za-z]|$)"
VERSION = r"[0-9]+([.][0-9]+)*"
NO_WORD = r"[^0-9a-z#]+"
#: Every known sentence holds one of these; a text without them isn't cut into sentences.
HINT = r"(?i)licen[cs]e|warrant|copyright|redistribut|public domain"


# Borders of parts of a text: after : and ;, after a sentence, at blank lines; single line ends stay as they are.
_SOFT, _HARD, _BLANK = "\x01", "\x02", "\x03"
_BORDERS = f"\n{_SOFT}{_HARD}{_BLANK}"
#: What is replaced, in this order, before known sentences are looked for; the text is in lower case.
_STEPS = [
    (r"\r\n?", "\n"),
    # Signs of comments, quotes and lists at the beginnings of lines.
    (r"(?m)^[^0-9a-z\n]+", ""),
    (r"(?m)^(?:(?:rem|dnl)[ \t]+|(?:[0-9]{1,2}|[a-z])\)[ \t]+)[^0-9a-z\n]*", ""),
    (r"\bv[.](?=\s*[0-9])", "v "),
    (r"[.!?](?=[^0-9a-z]|$)", _HARD),
    (r"[;:](?=[^0-9a-z]|$)", _SOFT),
    (r"\n[ \t]*\n\s*", _BLANK),
    (r"(?<![0-9])[.]|[.](?![0-9])", " "),
    (rf"[^0-9a-z#.{_BORDERS}]+", " "),
    (rf" *([{_BORDERS}]) *", "$1"),
]


def _pattern(sentences: dict[str, str]) -> str:
    """Any known sentence between two borders, the longest first, over line ends, : and ; but not over sentence ends.

    A blank line may stand before a link only.
    """
    def of(sentence: str) -> str:
        words = [VERSION.replace("(", "(?:") + "|#" if w == "#" else "https?" if w == "http" else re.escape(w) for w in sentence.split()]
        gaps = [f"[ \n{_SOFT}{_BLANK if w == 'https?' else ''}]+" for w in words]
        return "".join(gap * (i > 0) + f"(?:{w})" for i, (w, gap) in enumerate(zip(words, gaps, strict=True)))

    known = "|".join(of(s) for s in sorted(sentences, key=lambda s: (-len(s), s)))
    return f"(?<=[{_BORDERS}])(?:{known})(?=[{_BORDERS}]|$)"


def sentences_of(text: Column, sentences: dict[str, str]) -> Column:
    """Structs ``norm, version`` of the known sentences in order: their lower-case words, version numbers as #, and the first of these."""
    plain = F.lower(text)
    for pattern, by in _STEPS:
        plain = F.regexp_replace(plain, pattern, by)
    found = F.regexp_extract_all(F.concat(F.lit("\n"), plain), F.lit(_pattern(sentences)), F.lit(0))
    return F.transform(found, lambda s: F.struct(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(s, VERSION, "#"), NO_WORD, " "), r"\bhttps\b", "http").alias("norm"),
        F.regexp_extract(s, VERSION, 0).alias("version")))


def _named(licence: str, versions: Column) -> Column:
    return F.transform(versions, lambda v: F.replace(F.lit(licence), F.lit("@"), v))


def scan_licences(
    docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None,
    rules: list[tuple[str, list[str]]] | None = None, hint: str = HINT,
) -> DataFrame:
    """All columns with ``sentence_ids`` (in order, joined by blanks) and ``licences`` (sorted, distinct, joined by blanks).

    A known sentence stands between two line ends or signs .!?;: before something that is neither letter nor digit. It may be
    wrapped, with comment signs in front of its lines, and hold : and ;. Known sentences
    become identifiers with their version, all else vanishes. Rules are tried in
    their order, longest sequences first; what a rule matches is used up. A rule
    whose identifiers don't follow each other isn't met. Missing texts are empty and
    have no licence. Rows are independent: nothing is shuffled, repeated rows have equal results, no rows
    give none. Columns named like the two results are replaced.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = F.create_map(*[F.lit(x) for item in sentences.items() for x in item])
    ids = F.transform(
        sentences_of(whole(text), sentences),
        lambda s: F.concat(F.element_at(known, s["norm"]), F.lit("@"), s["version"]))
    hinted = F.when(whole(text).rlike(hint), ids).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn("sentence_ids", F.array_join(hinted, " "))
    # Each identifier is closed by a bar, so that a rule can't match inside another identifier.
    rest, found = F.concat(F.lit("|"), F.replace("sentence_ids", F.lit(" "), F.lit("||")), F.lit("|")), []
    for name, sequence in rules:
        pattern = "".join(rf"\|{identifier}@([^|]*)\|" for identifier in sequence)
        found.append(_named(name, F.regexp_extract_all(rest, F.lit(pattern), F.lit(1))))
        rest = F.regexp_replace(rest, pattern, "||")
    licences = F.array_join(F.array_sort(F.array_distinct(F.concat(*found))), " ")
    return out.withColumn("licences", F.when(F.col("sentence_ids") == "", "").otherwise(licences))
