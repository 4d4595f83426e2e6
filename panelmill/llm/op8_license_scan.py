"""Licence scans by sentence rules: normalised sentences become identifiers, identifier sequences are matched against ordered rules.

A text is cut after `.`, `!`, `?` before white space, and at line ends. A sentence is lower-cased and every run of other
characters than a-z and 0-9 becomes one space. A known sentence becomes its identifier, others break the sequence only where a
rule needs its identifiers side by side. Rules are tried in order, the more specific first; what a rule has matched is taken
out, so a later, more general rule cannot claim it again.

Edge cases: a null or empty text has no sentences and no licence. Rows are independent, so repeated rows, ties and empty
tables need no rule. Other columns than id and text are not read. Long texts are one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, as they are commonly written.
SENTENCES = {
    "apache_short": "Licensed under the Apache License, Version 2.0.",
    "apache_head": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache_use": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "mit_short": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,'
    " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
    " subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3_short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
    " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    " without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc_by_nc": "Licensed under CC BY-NC 4.0.",
    "cc_by": "Licensed under CC BY 4.0.",
    "cc_by_sa": "Licensed under CC BY-SA 4.0.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
    " conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
    " from this software without specific prior written permission.",
    "spdx_apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx_mit": "SPDX-License-Identifier: MIT",
}
# Licence and the identifiers that must follow one another among the known sentences of a text.
RULES = (
    ("Apache-2.0", ("apache_head", "apache_use", "apache_copy")),
    ("Apache-2.0", ("apache_head",)),
    ("Apache-2.0", ("apache_short",)),
    ("Apache-2.0", ("spdx_apache",)),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("spdx_mit",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope")),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("GPL-3.0-only", ("gpl3_short",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source")),
    ("BSD-2-Clause", ("bsd_grant",)),
)
CUT, ENDS, REST = r"([.!?])[ \t\r\n]+", r"\n+", r"[^a-z0-9]+"


def plain(sentence: str) -> str:
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in sentence.lower()).split())


def known(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence to identifier. A text with a full stop inside is cut there, so only its parts could be known."""
    return {plain(text): name for name, text in sentences.items()}


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), CUT, "$1\n"), ENDS)
    normal = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), REST, " ")))
    table = known(sentences)
    wanted = F.filter(normal, lambda s: s.isin(list(table)))
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.transform(wanted, lambda s: F.element_at(lookup, s))


def apply_rules(ids: Column, rules=RULES) -> Column:
    """Licences of an identifier sequence, sorted, each once."""
    state = F.struct(F.concat(F.lit("|"), F.array_join(ids, "|"), F.lit("|")).alias("left"), F.expr("cast(array() as array<string>)").alias("found"))
    ordered = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("|" + "|".join(seq) + "|").alias("seq")) for name, seq in rules))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["seq"])
        left = F.replace(F.replace(acc["left"], F.lit("|"), F.lit("||")), F.replace(rule["seq"], F.lit("|"), F.lit("||")), F.lit("|#|"))
        took = F.struct(F.regexp_replace(left, r"\|\|", "|").alias("left"), F.concat(acc["found"], F.array(rule["name"])).alias("found"))
        return F.when(hit, took).otherwise(acc)

    return F.aggregate(ordered, state, step, lambda acc: F.array_sort(F.array_distinct(acc["found"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses) per row."""
    marked = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text_col)).alias("sentence_ids"))
    none = F.expr("cast(array() as array<string>)")
    return marked.select("doc_id", "sentence_ids", F.when(F.size("sentence_ids") > 0, apply_rules(F.col("sentence_ids"))).otherwise(none).alias("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
    )


def _sql() -> str:
    values = ", ".join(f"('{text}', '{name}')" for text, name in known().items())
    single = {}
    for name, seq in RULES:
        if len(seq) == 1:
            single[seq[0]] = name
    names = ", ".join(f"('{i}', '{n}')" for i, n in single.items())
    return f"""WITH s AS (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS pos FROM (
  SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '\\n+') AS p FROM documents)),
k AS (SELECT doc_id, pos, id FROM s JOIN (VALUES {values}) v(t, id) ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = t),
a AS (SELECT doc_id, count(*) AS n_sentences, string_agg(id, ',' ORDER BY pos) AS sentence_ids FROM k GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses
  FROM k JOIN (VALUES {names}) r(one, licence) ON id = one GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id"""


#: The twin looks every single sentence up; where the tables hold whole licence texts, sequences are tested in tests/llm.
ORACLE_SQL = _sql()
