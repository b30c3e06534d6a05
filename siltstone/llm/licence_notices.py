"""Licence notices: full licence texts, header blocks and one-line notices anywhere in a document.

``licences`` tells what a document is as a whole; this tells which licences it carries.  The canonical form
is the one of ``licences``, but keeps line ends, and drops only true statements of copyright.  A full
text or a header block counts where all of its words follow each other, however the lines are wrapped; a
one-line notice and an SPDX tag count where they are an entire line or paragraph.

Scale: one scan, native, no shuffle; the known forms are literals in the plan (some 250 KB).  Only texts
that are longer than a known one are searched for it.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, quoted
from .licences import EQUIVALENT, KNOWN, canonical

#: A statement of copyright, up to what is said of a licence on the same line.
STATEMENT = r"(?m)^[ \t#*/;%<!-]*(?:copyright[ \t:]*(?:\(c\)|©|&copy;|[12][0-9]{3}|\[yyyy\]|<year>|\[year\]|19yy)|\(c\)[ \t]*(?:copyright|[12][0-9]{3})|©).*?(?=\b(?:licen[cs]ed|released|distributed|permission|this|spdx)\b|$)"

_GPL = "is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_GNU = {"GPL-1.0": ("General Public License", "1"), "GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.0": ("Library General Public License", "2"), "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}

# Header blocks, and the licences they name.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")'),
    *[(f"{name}-or-later", _GPL.format(f"{title}", version)) for name, (title, version) in _GNU.items()],
    *[(f"{name}-or-later", _GPL.format(f"{title}", version).replace("; you can", ": you can").replace("Foundation; either", "Foundation, either")) for name, (title, version) in _GNU.items()],
]

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

# Names of licences, as notices of one line give them.
NAMES = {
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License v2", "Apache 2.0", "Apache 2"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "FreeBSD"],
    "BSD-3-Clause": ["BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0", "EPL 2.0"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3", "GNU Free Documentation License 1.3", "GFDL 1.3"],
    "ISC": ["ISC"],
    "MIT": ["MIT", "Expat"],
    "MIT-0": ["MIT-0", "MIT No Attribution"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, Version 1.1", "Mozilla Public License, v. 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib"],
    **{f"CC-{code}-{v}": [f"CC {code} {v}", f"CC {code} {v} International", f"Creative Commons {title} {v}", f"Creative Commons {title} {v} {'International' if v == '4.0' else 'Unported'}", f"Creative Commons {code} {v}"] for code, title in _CC.items() for v in ("2.0", "2.5", "3.0", "4.0")},
    **{f"{name}-{kind}": [f"{start}{title}{between}{version}{end}" for start in ("GNU ", "") for between in (", version ", " ", " v") for end in ends] + [f"{start}{name[: name.index('-')]}{between}{version}{end}" for start in ("GNU ", "") for between in (" version ", " ", " v", "v") for end in ends]
       for name, (title, version) in _GNU.items() for kind, ends in (("only", ("", " only") if version.count(".") else ("", ".0", " only", ".0 only")), ("or-later", (" or later", " or any later version", "+") if version.count(".") else (" or later", ".0 or later", " or any later version")))},
}

#: What stands before the name in a notice, in canonical form.
_LEAD = r"(?:(?:this|the) [a-z]+(?: [a-z]+)? (?:is|are) |it is )?(?:dual )?(?:licensed|released|distributed|published|available|made available|provided) under (?:the )?(?:terms of )?(?:the )?"
_NOTICE = rf"(?m)^(?:{_LEAD}|spdx license identifier |license |licensed )([^\n]{{1,200}})$"
#: Licences that a notice lists.
_LISTED = " or (?!(?:any )?later)(?:the )?| and (?:the )?"
#: The headers that the GNU licences show as examples are not notices.
_EXAMPLE = r"one line to give the (?:program|library) s name and (?:a brief|an) idea of what it does (?:this (?:program|library) )?"


def texts() -> list[tuple[str, str]]:
    """The full licences; those with one text for two ids have the id without -only or -or-later."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return [(f.stem, f.read_text(encoding="utf-8")) for f in files] + [(name, text) for name, text in KNOWN if len(text) > 100 and not text.startswith("MIT License")]


def _lined(text: Column) -> Column:
    """The canonical form with its line ends; blank lines are empty."""
    bare = F.regexp_replace(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), STATEMENT, " "), r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", "  ")
    out = F.concat(F.lit(" "), F.replace(bare, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for one, other in EQUIVALENT:
        out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.regexp_replace(F.trim(F.regexp_replace(out, " {2,}", " ")), " ?\n ?", "\n")


def _flat(lined: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lined, "\n+", " ")), F.lit(" "))


def _forms(spark: SparkSession, known: list[tuple[str, str]], form) -> list[tuple[str, str]]:
    """Ids and distinct forms of the known texts, some dozens or hundreds of rows."""
    rows = spark.createDataFrame(known, "id string, text string").select("id", form(F.col("text")).alias("form")).collect()
    return [(name, found) for found, name in sorted({r["form"]: r["id"] for r in rows}.items())]


def find_notices(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_copyright, n_licenses, license_ids) for every row of ``docs``.

    ``license_ids`` are the distinct identifiers of all licences found, in code point order, with commas
    between; none, and a null text, give "".  ``n_copyright`` counts statements of copyright.
    Repeated rows are all returned; no other column is read.
    """
    spark, text = docs.sparkSession, F.col(quoted(text_col))
    named = [(name, n + end) for name, ns in NAMES.items() for n in [*ns, name] for end in ("", " License", " Public License", " licence")] + [(name, name) for name, _ in texts()]
    ids = F.create_map(*[F.lit(x) for name, form in _forms(spark, named, canonical) for x in (form, name)])
    blocks = [(name, form, F.col("_flat")) for name, form in _forms(spark, texts(), lambda c: _flat(_lined(c)))]
    blocks += [(name, form, F.col("_shown")) for name, form in _forms(spark, HEADERS, lambda c: _flat(_lined(c)))]
    forms = docs.select(F.col(quoted(id_col)).alias("_id"), F.regexp_count(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(STATEMENT)).cast("long").alias("n_copyright"), _lined(text).alias("_lined"))
    forms = forms.select("_id", "n_copyright", "_lined", _flat(F.col("_lined")).alias("_flat"))
    paragraphs = F.replace(F.replace(F.regexp_replace("_lined", "\n{2,}", "\f"), F.lit("\n"), F.lit(" ")), F.lit("\f"), F.lit("\n"))
    said = F.regexp_extract_all(F.concat("_lined", F.lit("\n"), paragraphs), F.lit(_NOTICE), F.lit(1))
    forms = forms.select("_id", "n_copyright", "_flat", F.regexp_replace("_flat", _EXAMPLE + "is free", " ").alias("_shown"), said.alias("_said"))
    by_name = F.transform(F.flatten(F.transform("_said", lambda s: F.split(s, _LISTED))), lambda s: F.element_at(ids, F.trim(s)))
    by_block = F.array(*[F.when(F.contains(where, F.lit(form)), F.lit(name)) for name, form, where in blocks])
    found = forms.select("_id", "n_copyright", F.array_sort(F.array_distinct(F.array_compact(F.concat(by_name, by_block)))).alias("_found"))
    return found.select(F.col("_id").alias(id_col), "n_copyright", F.size("_found").cast("long").alias("n_licenses"), F.array_join("_found", ",").alias("license_ids"))
