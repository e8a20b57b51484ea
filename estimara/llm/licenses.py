"""License scans: whole texts, in a canonical form, joined by digest to known licences; notices of one line are looked up, too."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_digests import DIGESTS
from .shared import small, stage

# Texts of public licences, without their copyright lines.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LICENSES = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD.format(third=""),
    "BSD-3-Clause": _BSD.format(third="3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"),
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
# A further short text, and title lines that may stand before a short text.
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD", "Zero-Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "The BSD 2-Clause License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "The BSD 3-Clause License", "BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
# Notices of a line each.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Released under the MIT License.": "MIT",
    "Released under the ISC License.": "ISC",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: MIT": "MIT",
}
# Spellings that count as equal, after case and punctuation; the first from a word's beginning on.
EQUAL = {"licence": "license", "sub license": "sublicense", "non infringement": "noninfringement", "non commercial": "noncommercial", "organisation": "organization", "authorisation": "authorization", "favour": "favor", "honour": "honor", "https": "http"}
ANY_EQUAL = r"\b(" + "|".join(EQUAL) + ")"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = "\t\r\v\f!\"#$%'()*+,-./:;<=>?@[\\]^_`{|}~ ‘’“”–—•"
# How a notice begins in canonical form, and words that a notice (years, holders) doesn't have, but terms do.
COPYRIGHT = "^(c )?copyright (c$|c |[0-9]{4})|^c [0-9]{4}|^(c )?copyright the .*(authors|contributors|developers|team|project|foundation)$|^all rights reserved$"
TERMS = r"\b(is|are|was|were|be|been|being|has|have|had|does|did|done|might|must|shall|should|would|cannot|could|need|use|uses|used|using|copy|copies|copied|copying|no|not|nor|none|nothing|never|any|anything|anyone|all|every|this|that|these|those|you|your|we|our|they|their|who|which|what|whatever|where|when|if|unless|except|only|without|within|under|permission|permissions|permit|permits|permitted|license|licensed|licenses|forbidden|forbid|prohibited|prohibit|granted|allowed|allow|allows|reserved|rights|terms|conditions|applies|apply|redistribute|redistribution|redistributed|distribute|distributed|modify|modified|sell|sold)\b"
#: Sentences of a line that may be notices, one after another, before what isn't.
SENTENCES = 3


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def folded(line: Column) -> Column:
    """Lower case, no punctuation, one blank between words, equal spellings."""
    plain = F.translate(F.replace(line, F.lit("&"), F.lit(" and ")), UPPER + "©" + PUNCTUATION, LOWER + "c" + " " * len(PUNCTUATION))
    spelled = lambda x: reduce(lambda text, pair: F.regexp_replace(text, r"\b" + pair[0], pair[1]), EQUAL.items(), x)
    return let(F.trim(F.regexp_replace(plain, " +", " ")), lambda x: F.when(x.rlike(ANY_EQUAL), spelled(x)).otherwise(x))


def is_notice(line: Column) -> Column:
    """Of a line in canonical form: nothing but years, holders and "all rights reserved"."""
    return line.rlike(COPYRIGHT) & ((line == "all rights reserved") | ~F.regexp_replace(line, " all rights reserved$", "").rlike(TERMS))


def after_notices(line: Column) -> Column:
    """The line without the sentences that it begins with, if these are notices."""

    def rest(x: Column) -> Column:
        return let(F.regexp_extract(x, r"^[^.]*[.][ \t]+", 0), lambda head: F.when(let(folded(head), is_notice), F.substr(x, F.length(head) + 1)).otherwise(x))

    return reduce(lambda x, _: let(x, rest), range(SENTENCES), line)


def canonical_line(line: Column) -> Column:
    """The line folded, without a copyright notice: the whole line, or the sentences that it begins with. All else of the line stays."""

    def judged(whole: Column) -> Column:
        last = let(folded(after_notices(line)), lambda x: F.when(is_notice(x), F.lit("")).otherwise(x))
        return F.when(~whole.rlike("^(c )?copyright |^c [0-9]|^all rights reserved"), whole).when(is_notice(whole), F.lit("")).otherwise(last)

    return let(folded(line), judged)


def canonical_lines(text: Column) -> Column:
    """The lines that aren't empty in canonical form; a null text has none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x != "")


def digest_of(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of the short texts: plain, BSD also without its conditions' numbers, each with and without a title."""
    plain = [*LICENSES.items(), ("Unlicense", UNLICENSE)]
    plain += [(name, re.sub(r"(?m)^[1-3]\. ", "", text)) for name, text in plain if name.startswith("BSD-")]
    return [(name, title + text) for name, text in plain for title in ("", *(f"{t}\n" for t in TITLES[name]))]


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license) of the known texts; a fixed, small table. Long texts are known by digest only."""
    short = spark.createDataFrame(known_texts(), "license string, text string")
    long = spark.createDataFrame(list(DIGESTS.items()), "digest string, license string")
    return short.select(digest_of(canonical_lines(F.col("text"))).alias("digest"), "license").distinct().unionByName(long)


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the canonical text, license (null: the text is no known one), n_notices and notices, a row for each row.

    Two texts have one digest if they differ in case, punctuation, line breaks,
    copyright lines or listed spellings only. A null text counts as empty; an
    empty canonical text has a digest but no licence. Very long texts count
    whole, repeated rows stay repeated, an empty table gives an empty result, and
    other columns aren't looked at. notices: ordered names,
    comma-joined, of the licences that a line of the text declares. The only
    join is with the known digests. known: a table (digest, license) of them; of
    a digest with several licences the first by name counts. Without it, the
    fixed table of known texts is used, and nothing is shuffled.
    """
    if known is None:
        table = F.broadcast(known_digests(docs.sparkSession))
    else:
        table = stage(known.where("digest is not null").groupBy("digest").agg(F.min("license").alias("license")), "known-licenses")
        table = small(table, table.count())
    notices = docs.sparkSession.createDataFrame(list(NOTICES.items()), "line string, license string")
    by_line = {r["line"]: r["license"] for r in notices.select(canonical_line(F.col("line")).alias("line"), "license").collect()}
    line_names = F.create_map(*(F.lit(x) for pair in by_line.items() for x in pair))
    lines = docs.select(F.col(doc_id).cast("long").alias("doc_id"), canonical_lines(F.col(text).cast("string")).alias("lines"))
    declared = F.filter(F.transform("lines", lambda x: F.try_element_at(line_names, x)), lambda x: x.isNotNull())
    scanned = lines.select("doc_id", digest_of(F.col("lines")).alias("digest"), declared.alias("declared"))
    joined = scanned.join(table, "digest", "left")
    return joined.select("doc_id", "digest", "license", F.size("declared").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("declared")), ",").alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    """The scan in DuckDB's SQL."""

    def fold(x: str) -> str:
        plain = f"translate(replace({x}, '&', ' and '), {_quoted(UPPER + chr(0xA9) + PUNCTUATION)}, {_quoted(LOWER + 'c' + ' ' * len(PUNCTUATION))})"
        return f"trim(regexp_replace({plain}, ' +', ' ', 'g'), ' ')"

    def spell(x: str) -> str:
        return reduce(lambda text, pair: f"regexp_replace({text}, {_quoted(chr(92) + 'b' + pair[0])}, {_quoted(pair[1])}, 'g')", EQUAL.items(), x)

    def notice(x: str) -> str:
        return f"(regexp_matches({x}, {_quoted(COPYRIGHT)}) and ({x} = 'all rights reserved' or not regexp_matches(regexp_replace({x}, ' all rights reserved$', ''), {_quoted(TERMS)})))"

    head = r"regexp_extract(rest, '^[^.]*[.][ \t]+', 0)"

    def canonical(table: str, key: str, text: str) -> str:
        steps = f"select {key} as key, unnest(string_split(coalesce({text}, ''), chr(10))) as rest, generate_subscripts(string_split(coalesce({text}, ''), chr(10)), 1) as i from {table}"
        steps = f"select key, i, rest, {spell(fold('rest'))} as whole from ({steps})"
        for _ in range(SENTENCES):
            steps = f"select key, i, whole, case when {notice('head_fold')} then substr(rest, length(head) + 1) else rest end as rest from (select *, {spell(fold('head'))} as head_fold from (select *, {head} as head from ({steps})))"
        lines = f"""select key, i, case when not regexp_matches(whole, '^(c )?copyright |^c [0-9]|^all rights reserved') then whole when {notice('whole')} or {notice('last')} then '' else last end as line from (select *, {spell(fold('rest'))} as last from ({steps}))"""
        return f"select key, coalesce(list(line order by i) filter (line <> ''), []) as lines from ({lines}) group by key"

    known = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(known_texts()))
    digests = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in DIGESTS.items())
    notices = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in NOTICES.items())
    return f"""with known(number, license, text) as (values {known}), notices(notice, license) as (values {notices}),
    known_lines as ({canonical("known", "number", "text")}), notice_lines as ({canonical("notices", "notice", "notice")}),
    doc_lines as ({canonical("documents", "doc_id", "text")}),
    digests(digest, license) as (select distinct sha256(array_to_string(lines, ' ')), license from known_lines join known on number = key union all values {digests}),
    by_line as (select lines[1] as line, license from notice_lines join notices on notice = key),
    declared as (select key, count(*) as n, string_agg(distinct license, ',' order by license) as names from (select key, unnest(lines) as line from doc_lines) join by_line using (line) group by key)
    select d.key as doc_id, sha256(array_to_string(d.lines, ' ')) as digest, k.license, coalesce(n, 0)::bigint as n_notices, coalesce(names, '') as notices
    from doc_lines d left join digests k on k.digest = sha256(array_to_string(d.lines, ' ')) left join declared e on e.key = d.key"""
