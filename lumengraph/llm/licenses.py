"""Operator 3, licence scans: canonical digest lookup.

A text's canonical form has ASCII letters in lower case, punctuation and white space as single spaces, lines that are
copyright notices taken out and equivalent spellings made one. The SHA-256 of a document's whole canonical text is
hash-joined to the digests of known licences; each of its canonical lines that is as long as a known one is looked up
the same way, which finds licence notices that stand in a line of their own.

Null and empty texts have the digest of the empty form and match nothing; repeated rows each give a row; null ids and
further columns are carried or ignored alike; an empty table gives an empty result. Only DataFrame functions; one pass
over the scan, and the known table (a parameter of some hundred kilobytes) is the other side of the join.
"""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import common

#: Equivalent spellings, from and to; applied in this order to the lower-case text.
SPELLINGS = {
    "licence": "license",
    "sub-license": "sublicense",
    "favour": "favor",
    "acknowledgement": "acknowledgment",
    "authoris": "authoriz",
    "organis": "organiz",
    "merchantib": "merchantab",
    "non-commercial": "noncommercial",
    "non-infringement": "noninfringement",
    "whilst": "while",
    "per cent": "percent",
    "judgement": "judgment",
    "http://": "https://",
    "&": "and",
    "©": "(c)",
}
#: Versions 2.0 and 3.0 are 2 and 3, but not as the start of a longer number.
VERSION = "version ([23])[.]0([^0-9.]|$|[.][^0-9]|[.]$)"
#: Everything in ASCII but letters, digits and line ends, and typographic marks.
PUNCTUATION = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F‘’“”–—® ]+"
#: The rule that the SQL has.
_SQL_NOTICE = "^ ?c [0-9]{4} |^ ?copyright (c )?[0-9]{4}|^ ?all rights reserved ?$"
#: Words after "copyright" at the head of a line that is wrapped text of a licence, not a notice.
_PROSE = "notices?|holders?|owners?|laws?|license[sd]?|licenses?|interests?|statements?|disclaimers?|status|treat(y|ies)|protection|infringement|permission|works?|rights?|claims?|act|acts|grants?|and|or|in|on|to|of|is|are|was|as|for|which|with|without|this|that|these|any|applies|applicable|may|shall|will|can|if|it|from|under|information|like|the (software|program|library|work|covered|original)"
NOTICE = f"{_SQL_NOTICE}|^ ?c copyright( |$)|^ ?copyright( c( .*)?)? ?$|^ ?copyright (?!c |({_PROSE})( |$))"
#: So many first characters tell which lines may be known ones.
HEAD = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DENIAL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: The known texts that the SQL has.
_SQL_KNOWN = {
    "MIT": _MIT,
    "MIT (titled)": f"MIT License\n\n{_MIT}",
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DENIAL}",
    "0BSD": f"{_ISC_GRANT}.\n\n{_ISC_DENIAL}",
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
}
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

{a} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{b} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {who} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = "{c} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""


def _bsd(title: str, third: str) -> list[str]:
    """Numbered and starred, with the usual two words for who isn't liable, with and without a title."""
    texts = [_BSD.format(a=a, b=b, third=third.format(c=c), who=who) for a, b, c in ("123", "***") for who in ("HOLDER", "OWNER", "HOLDERS")]
    return texts + [f"{t}\n\n{x}" for t in (title, title.replace('"', "")) for x in texts]


def _files() -> dict[str, list[str]]:
    """Whole texts beside this file; those with an appendix on how to apply them, also without it."""
    out = {}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text("utf-8")
        end = text.find("END OF TERMS AND CONDITIONS")
        cut = [text[:end], text[: end + len("END OF TERMS AND CONDITIONS")]] if end >= 0 else []
        out[path.stem] = [text, *cut]
    return out


_VERSIONS = {"Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache 2.0"], "MIT": ["MIT License", "MIT"], "ISC": ["ISC License", "ISC"], "0BSD": ["Zero-Clause BSD License", "0BSD License"], "Zlib": ["zlib License"], "Unlicense": ["Unlicense"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"], "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"]}
_VERSIONS |= {f"BSD-{n}-Clause": [f"BSD {n}-Clause License", f"{n}-Clause BSD License", f"BSD-{n}-Clause License", f"BSD-{n}-Clause"] for n in (2, 3)}
_VERSIONS |= {f"MPL-{v}": [f"Mozilla Public License {v}", f"Mozilla Public License, Version {v}", f"Mozilla Public License, v. {v}", f"MPL {v}", f"MPL-{v}"] for v in ("1.1", "2.0")}
for _s, _g, _all in (("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",))):
    for _v in _all:
        _n = [_v, _v.removesuffix(".0")]
        _VERSIONS[f"{_s}-{_v}"] = [f"{_g}{x}{n}" for x in (", version ", " version ", " v", ", v") for n in _n] + [f"{_s}{x}{n}" for x in ("v", " v", "-", " ") for n in _n]
for _k, _w in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _v, _x in (("3.0", "Unported"), ("4.0", "International")):
        _VERSIONS[f"CC-{_k}-{_v}"] = [f"CC {_k} {_v}", f"Creative Commons {_w} {_v}", f"Creative Commons {_w} {_v} {_x}", f"Creative Commons {_w} {_v} {_x} License", f"Creative Commons {_w} {_v} License"]
_VERSIONS["CC0-1.0"] = ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"]
#: Heads of notices that count as one, in canonical lines.
_FORM = "^(this [a-z]+ is )?(licensed|released|distributed) under (the terms of )?(the |an? )?"


def _notices() -> dict[str, list[str]]:
    """Lines that name a licence, and SPDX identifiers, bare and as comments (punctuation doesn't count)."""
    out = {}
    for key, names in _VERSIONS.items():
        ids = [key, f"{key}-only", f"{key}-or-later", f"{key}+"] if "GPL" in key else [key]
        lines = [f"Licensed under {n}" for n in names] + [f"SPDX-License-Identifier: {i}" for i in ids]
        out[f"{key} (notice)"] = lines
    return out


def _known() -> dict[str, str | list[str]]:
    out = dict(_SQL_KNOWN) | _files() | {"BSD-2-Clause": _bsd("BSD 2-Clause License", ""), "BSD-3-Clause": _bsd("BSD 3-Clause License", _THIRD), "Zlib": [_ZLIB, f"zlib License\n\n{_ZLIB}"]}
    out["ISC (titled)"] = f"ISC License\n\n{out['ISC']}"
    for k, lines in _notices().items():
        out[k] = [*([out[k]] if k in out else []), *lines]
    return out


#: Known texts, one or several of a name: whole licences and one-line notices.
KNOWN = _known()


def canonical_lines(text: Column) -> Column:
    """Canonical lines that hold something, without copyright notices."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for a, b in SPELLINGS.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, VERSION, "version $1$2"), PUNCTUATION, " ")
    lines = F.transform(F.filter(F.split(t, "\n"), lambda x: ~x.rlike(NOTICE)), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def notice_form(line: Column) -> Column:
    return F.regexp_replace(line, _FORM, "licensed under ")


def known_table(spark: SparkSession, known: Mapping[str, str | list[str]] = KNOWN) -> DataFrame:
    """license and canonical form of each known text."""
    named = [(k, x) for k, v in known.items() for x in ([v] if isinstance(v, str) else v)]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in named))).alias("r")
    return spark.range(1).select(rows).select(F.col("r.license").alias("license"), F.array_join(canonical_lines(F.col("r.text")), " ").alias("form"))


def scan(docs: DataFrame, known: Mapping[str, str | list[str]] = KNOWN) -> DataFrame:
    """doc_id, digest, license (the whole text's, or null) and notices (sorted names of lines' licences, comma-separated)."""
    spark, line = docs.sparkSession, notice_form(F.col("form"))
    found = known_table(spark, known).select("license", digest(F.col("form")).alias("digest"), digest(line).alias("line"), F.length(line).alias("length"), F.substring(line, 1, HEAD).alias("head"))
    rows, whole, notice = found.collect(), {}, {}  # as many as the parameter has
    for r in rows:  # of equal forms the first name holds
        whole.setdefault(r.digest, r.license)
        notice.setdefault(r.line, r.license)
    names = F.create_map(*(F.lit(x) for kv in notice.items() for x in kv))
    lengths, heads = sorted({r.length for r in rows}), sorted({r["head"] for r in rows})
    d = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    short = F.filter(F.transform("lines", notice_form), lambda x: F.length(x).isin(lengths) & F.substring(x, 1, HEAD).isin(heads))
    hits = F.filter(F.transform(short, lambda x: F.element_at(names, digest(x))), lambda x: x.isNotNull())
    d = d.select("doc_id", digest(F.array_join("lines", " ")).alias("digest"), F.array_join(F.sort_array(F.array_distinct(hits)), ",").alias("notices"))
    table = F.explode(F.array(*(F.struct(F.lit(k).alias("digest"), F.lit(v).alias("license")) for k, v in whole.items()))).alias("r")
    return d.join(spark.range(1).select(table).select("r.*"), "digest", "left").select("doc_id", "digest", "license", "notices")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    form = f"translate(text, '{UPPER}', '{LOWER}')"
    for a, b in SPELLINGS.items():
        form = f"replace({form}, {_quoted(a)}, {_quoted(b)})"
    form = f"regexp_replace(regexp_replace({form}, '{VERSION}', 'version \\1\\2', 'g'), '{PUNCTUATION}', ' ', 'g')"
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in _SQL_KNOWN.items())

    def lines(source: str) -> str:
        return f"""SELECT k, n, trim(line) AS line FROM (
            SELECT k, unnest(string_split(form, chr(10))) AS line, unnest(range(len(string_split(form, chr(10))))) AS n
            FROM (SELECT k, {form} AS form FROM {source}))
        WHERE NOT regexp_matches(line, '{_SQL_NOTICE}') AND trim(line) <> ''"""

    return f"""
    WITH known(k, text) AS (VALUES {values}),
    kl AS ({lines("known")}),
    kd AS (SELECT k AS license, sha256(string_agg(line, ' ' ORDER BY n)) AS digest FROM kl GROUP BY k),
    docs AS (SELECT doc_id AS k, coalesce(text, '') AS text FROM documents),
    dl AS ({lines("docs")}),
    dd AS (SELECT k, sha256(string_agg(line, ' ' ORDER BY n)) AS digest FROM dl GROUP BY k),
    nn AS (SELECT k, string_agg(license, ',' ORDER BY license) AS notices
           FROM (SELECT DISTINCT dl.k, kd.license FROM dl JOIN kd ON sha256(dl.line) = kd.digest) GROUP BY k)
    SELECT docs.k AS doc_id, coalesce(dd.digest, sha256('')) AS digest, kd.license, coalesce(nn.notices, '') AS notices
    FROM docs LEFT JOIN dd ON docs.k = dd.k LEFT JOIN kd ON dd.digest = kd.digest LEFT JOIN nn ON docs.k = nn.k
    """
