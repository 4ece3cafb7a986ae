"""License detection by ordered signature rules, in DataFrame expressions only.

Some hundreds of rules are a license's names put into a few kinds of phrase (identifier, grant, title, web address).
Every match holds its kind's anchor, a fixed word of the phrase, and at least one of the rule's keywords, which are read off the
names' own expressions. A text is first tested for anchors; only texts that hold one are tested for keywords, and only rules whose anchor
and one keyword stand in the text run their regular expression, so no match is lost. Detections are intervals.
One that lies within another of the same or a higher priority is suppressed, ordered by start, then longest, then
priority. What survives gives the labels and the score, 1 - product(1 - weight of the rule's priority).

The base counts (places of fixed phrases of whole words) are kept beside it, and their labels always stay.

Defined results: null and empty texts have 0 words, no labels and score 0; repeated rows are scanned each.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: label, names as regular expressions, SPDX identifiers, web address. Facts about public licences.
LICENSES = [
    ("mit", r"MIT|Massachusetts Institute of Technology", "MIT", r"opensource\.org/licenses?/mit"),
    ("mit-0", r"MIT[- ]No[- ]Attribution", "MIT-0", r"opensource\.org/licenses?/mit-0"),
    ("x11", r"X11|X Consortium", "X11", r"xfree86\.org/.{0,30}licen[cs]e"),
    ("apache-1.1", r"Apache(?: Software)?(?: License)?,?\s+(?:v|version\s*)?1\.1", "Apache-1.1", r"apache\.org/licenses/LICENSE-1\.1"),
    ("apache-2.0", r"Apache(?: Software)?(?: License)?,?\s+(?:v|version\s*)?2(?:\.0)?", "Apache-2.0", r"apache\.org/licenses/LICENSE-2\.0"),
    ("gpl-2.0", r"(?:GNU\s+)?(?:General\s+Public\s+Licen[cs]e|GPL),?\s*(?:v|version\s*)?2(?:\.0)?", r"GPL-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"),
    ("gpl-3.0", r"(?:GNU\s+)?(?:General\s+Public\s+Licen[cs]e|GPL),?\s*(?:v|version\s*)?3(?:\.0)?", r"GPL-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3"),
    ("gpl", r"GNU\s+General\s+Public|GNU\s+GPL|GPL", r"GPL", r"gnu\.org/(?:copyleft|licenses)/gpl"),
    ("lgpl", r"GNU\s+(?:Lesser|Library)\s+General\s+Public|(?:GNU\s+)?LGPL(?:v?[23](?:\.[01])?)?", r"LGPL-[23]\.[01](?:-only|-or-later|\+)?", r"gnu\.org/(?:copyleft|licenses)/lgpl"),
    ("agpl", r"GNU\s+Affero(?:\s+General\s+Public)?|Affero\s+General\s+Public", r"AGPL-[13]\.0(?:-only|-or-later)?", r"gnu\.org/licenses/agpl"),
    ("agpl", r"AGPL(?:v?3)?", r"AGPL-3\.0", r"gnu\.org/licenses/agpl"),
    ("gfdl", r"GNU\s+Free\s+Documentation|GFDL", r"GFDL-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("bsd-2-clause", r"(?:Simplified|FreeBSD|2[- ]clause|two[- ]clause)\s+BSD|BSD[- ]2[- ]clause", "BSD-2-Clause", r"opensource\.org/licenses?/bsd-2"),
    ("bsd-3-clause", r"(?:New|Modified|Revised|3[- ]clause|three[- ]clause)\s+BSD|BSD[- ]3[- ]clause", "BSD-3-Clause", r"opensource\.org/licenses?/bsd-3"),
    ("bsd-4-clause", r"(?:Original|4[- ]clause)\s+BSD|BSD[- ]4[- ]clause", "BSD-4-Clause", r"spdx\.org/licenses/BSD-4"),
    ("0bsd", r"Zero[- ]clause\s+BSD|0BSD", "0BSD", r"opensource\.org/licenses?/0bsd"),
    ("bsd", r"BSD(?:[- ]style)?", "BSD", r"opensource\.org/licenses?/bsd-license"),
    ("isc", r"ISC|Internet Systems Consortium", "ISC", r"opensource\.org/licenses?/isc"),
    ("mpl-1.1", r"Mozilla\s+Public(?:\s+Licen[cs]e)?,?\s*(?:v|version\s*)?1\.1", r"MPL-1\.1", r"mozilla\.org/MPL/1\.1"),
    ("mpl-2.0", r"Mozilla\s+Public(?:\s+Licen[cs]e)?,?\s*(?:v|version\s*)?2(?:\.0)?", r"MPL-2\.0", r"mozilla\.org/MPL/2\.0"),
    ("mpl", r"MPL(?:[- ]?[12]\.[01])?", "MPL", r"mozilla\.org/MPL"),
    ("epl", r"Eclipse\s+Public|Eclipse\s+Distribution", r"EPL-[12]\.0", r"eclipse\.org/(?:legal|org/documents)/epl"),
    ("cddl", r"CDDL|Common\s+Development\s+and\s+Distribution", r"CDDL-1\.[01]", r"opensource\.org/licenses?/cddl"),
    ("cpl", r"Common\s+Public", r"CPL-1\.0", r"opensource\.org/licenses?/cpl"),
    ("eupl", r"European\s+Union\s+Public|EUPL", r"EUPL-1\.[12]", r"eupl\.eu"),
    ("artistic", r"(?:Clarified\s+)?Artistic", r"Artistic-[12]\.0", r"perlfoundation\.org/artistic"),
    ("zlib", r"zlib(?:/libpng)?", "Zlib", r"zlib\.net/zlib_license"),
    ("libpng", r"libpng", "Libpng", r"libpng\.org/pub/png/src/libpng-LICENSE"),
    ("bsl-1.0", r"Boost\s+Software", r"BSL-1\.0", r"boost\.org/LICENSE_1_0"),
    ("unlicense", r"(?:The\s+)?Unlicense", "Unlicense", r"unlicense\.org"),
    ("wtfpl", r"WTFPL", "WTFPL", r"wtfpl\.net"),
    ("cc0-1.0", r"CC0(?:[- ]1\.0)?(?:\s+Universal)?", r"CC0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", r"CC[- ]BY(?![- ]?(?:NC|SA|ND))(?:[- ][234]\.[05])?", r"CC-BY-[234]\.[05]", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", r"CC[- ]BY[- ]SA(?:[- ][234]\.[05])?", r"CC-BY-SA-[234]\.[05]", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nc", r"CC[- ]BY[- ]NC(?![- ]?(?:SA|ND))(?:[- ][234](?:\.[05])?)?", r"CC-BY-NC-[234]\.[05]", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", r"CC[- ]BY[- ]NC[- ]SA(?:[- ][234]\.[05])?", r"CC-BY-NC-SA-[234]\.[05]", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nd", r"CC[- ]BY[- ]ND(?:[- ][234]\.[05])?", r"CC-BY-ND-[234]\.[05]", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc-nd", r"CC[- ]BY[- ]NC[- ]ND(?:[- ][234]\.[05])?", r"CC-BY-NC-ND-[234]\.[05]", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc", r"Creative\s+Commons(?:\s+Attribution(?:[- ](?:ShareAlike|NonCommercial|NoDerivs|NoDerivatives))*)?", "CC", r"creativecommons\.org/licenses"),
    ("public-domain", r"(?:the\s+)?public\s+domain", "PD", r"creativecommons\.org/publicdomain/mark"),
    ("ofl-1.1", r"(?:SIL\s+)?Open\s+Font", r"OFL-1\.1", r"scripts\.sil\.org/OFL"),
    ("python-2.0", r"Python\s+Software\s+Foundation|PSF", r"(?:Python|PSF)-2\.0", r"python\.org/psf/license"),
    ("ruby", r"Ruby", "Ruby", r"ruby-lang\.org/.{0,10}LICENSE"),
    ("php-3.01", r"PHP", r"PHP-3\.01?", r"php\.net/license"),
    ("openssl", r"OpenSSL", "OpenSSL", r"openssl\.org/source/license"),
    ("ms-pl", r"Microsoft\s+Public", "MS-PL", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", r"Microsoft\s+Reciprocal", "MS-RL", r"opensource\.org/licenses?/ms-rl"),
    ("osl-3.0", r"Open\s+Software", r"OSL-[123]\.[01]", r"opensource\.org/licenses?/osl"),
    ("afl-3.0", r"Academic\s+Free", r"AFL-[123]\.[01]", r"opensource\.org/licenses?/afl"),
    ("ncsa", r"(?:University\s+of\s+Illinois/)?NCSA(?:\s+Open\s+Source)?", "NCSA", r"otm\.illinois\.edu"),
    ("postgresql", r"PostgreSQL", "PostgreSQL", r"postgresql\.org/about/licen[cs]e"),
    ("odbl", r"Open\s+(?:Data\s*Commons\s+Open\s+)?Database|ODbL", r"ODbL-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("sspl-1.0", r"Server\s+Side\s+Public|SSPL", r"SSPL-1\.0", r"mongodb\.com/licensing/server-side"),
    ("busl-1.1", r"Business\s+Source", r"BUSL-1\.1", r"mariadb\.com/bsl11"),
    ("elastic-2.0", r"Elastic", r"Elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("proprietary", r"All\s+rights\s+reserved", "LicenseRef-Proprietary", r"all-rights-reserved"),
]
#: Kinds of phrase: priority, weight towards the score, anchor (lower case) that every match holds, and the phrase around {names}, {spdx} or {url}.
KINDS = [
    (5, 0.99, "spdx-license-identifier:", r"\bSPDX-License-Identifier:\s*(?:\([^()\n]*?\b)?{spdx}(?![\w.-]*\w)"),
    (4, 0.9, "under", r"\b(?:licen[cs]ed|released|distributed|available|provided|published|covered|redistribut\w+|used?)\s+(?:\w+\s+)??(?:\w+\s+)??under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?(?:{names})\b(?:,?\s*licen[cs]e)?(?:,?\s*(?:v|version\s*)?\d(?:\.\d+)*)?"),
    (3, 0.8, "://", r"\bhttps?://(?:www\.)?{url}[\w./-]*"),
    (2, 0.6, "licen", r"\b(?:the\s+)?(?:{names})\s*(?:\(\w+\)\s*)?licen[cs]e(?:d\b)?(?:,?\s*(?:v|version\s*)?\d(?:\.\d+)*)?"),
    (1, 0.4, "licen", r"\blicen[cs]e\s*[:=]\s*[\"']?(?:{names}|{spdx})\b"),
]

SEP, WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Base phrases: label and words.
BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, weight, anchor, regular expression), in their order."""
    return [
        (label, priority, weight, anchor, "(?i)" + phrase.replace("{names}", names).replace("{spdx}", f"(?:{spdx})").replace("{url}", f"(?:{url})"))
        for priority, weight, anchor, phrase in KINDS
        for label, names, spdx, url in LICENSES
    ]


def keywords() -> list[list[str]]:
    """Of each of rules(): lower-case strings of which every match holds at least one."""
    return [
        sorted(set().union(*(needed(part) for name, part in (("{names}", names), ("{spdx}", spdx), ("{url}", url)) if name in phrase)))
        for _, _, _, phrase in KINDS
        for _, names, spdx, url in LICENSES
    ]


def needed(regex: str) -> set[str]:
    """Lower-case strings of which every match of the expression holds at least one: the choice whose shortest is longest."""

    def choices(items) -> list[set[str]]:
        out, run = [], ""
        for op, arg in items:
            if op is C.LITERAL:
                run += chr(arg).lower()
                continue
            out.append({run})
            run = ""
            if op is C.SUBPATTERN:
                out += choices(arg[3])
            elif op is C.MAX_REPEAT and arg[0] > 0:
                out += choices(arg[2])
            elif op is C.BRANCH:
                out.append(set().union(*(best(b) for b in arg[1])))
        return [*out, {run}]

    def best(items) -> set[str]:
        return max(choices(items), key=lambda words: min(map(len, words)))

    return best(_parser.parse(regex))


def base_regex(words: tuple[str, ...]) -> str:
    return rf"(?i)(?<!{WORD}){(SEP + '+').join(words)}(?!{WORD})"


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base_labels (an array) of a text that isn't null."""
    count = lambda t, r: F.regexp_count(t, F.lit(r)).cast("long")
    any_of = "(?:" + "|".join(base_regex(w).removeprefix("(?i)") for _, w in BASE) + ")"
    n_base = count(text, "(?i)" + any_of)
    some = n_base > 0
    before = lambda lead: count(F.regexp_extract(text, f"(?is)^({lead}){any_of}", 1), f"{WORD}+")
    return {
        "n_words": count(text, f"{WORD}+"),
        "n_base": n_base,
        "first_word": F.when(some, before(".*?")),
        "last_word": F.when(some, before(".*")),
        "base_labels": F.when(some, F.array_compact(F.array(*[F.when(text.rlike(base_regex(w)), F.lit(label)) for label, w in sorted(BASE)]))).otherwise(F.array().cast("array<string>")),
    }


def detections(text: Column) -> Column:
    """Array of struct(start, stop, label, priority, weight) of all rules that match."""
    strings = lambda words: F.array(*map(F.lit, words))
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(w).alias("weight"), F.lit(a).alias("anchor"), strings(k).alias("keywords"), F.lit(r).alias("regex")) for (label, p, w, a, r), k in zip(rules(), keywords())])
    words = strings(sorted({a for _, _, a, _ in KINDS}.union(*keywords())))

    def places(rule: Column) -> Column:
        """Starts follow from the lengths of the matches and of what stands between them."""
        found = F.regexp_extract_all(text, rule["regex"], F.lit(0))
        between = F.split(text, rule["regex"], -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

        def add(acc: Column, pair: Column) -> Column:
            begin = acc["at"] + F.length(pair["0"])
            stop = begin + F.length(pair["1"])
            return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), stop.alias("stop")))).alias("spans"))

        pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("0"), found.alias("1"))
        spans = F.aggregate(pairs, start, add, lambda acc: acc["spans"])
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["weight"].alias("weight")))

    held = F.transform(F.array(F.lower(text)), lambda low: F.filter(words, lambda w: F.contains(low, w)))  # the text is lowered once
    present = F.flatten(F.transform(held, lambda h: F.filter(table, lambda r: F.array_contains(h, r["anchor"]) & F.arrays_overlap(h, r["keywords"]))))
    return F.flatten(F.transform(F.filter(present, lambda r: F.regexp_like(text, r["regex"])), places))


def resolved(found: Column) -> Column:
    """struct(labels, n_kept, miss): what is left of the detections; miss is the product of 1 - weight."""
    order = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["stop"] != b["stop"], b["stop"] - a["stop"]).otherwise(b["priority"] - a["priority"]))
    levels = sorted({p for p, *_ in KINDS})
    start = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0).alias("n_kept"), F.lit(1.0).alias("miss"), *[F.lit(-1).alias(f"end{p}") for p in levels])

    def step(acc: Column, d: Column) -> Column:
        reach = F.greatest(F.lit(-1), F.lit(-1), *[F.when(d["priority"] <= p, acc[f"end{p}"]).otherwise(-1) for p in levels])
        keep = reach < d["stop"]
        return F.struct(
            F.when(keep, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(keep, acc["n_kept"] + 1).otherwise(acc["n_kept"]).alias("n_kept"),
            F.when(keep, acc["miss"] * (1 - d["weight"])).otherwise(acc["miss"]).alias("miss"),
            *[F.when(keep & (d["priority"] == p), F.greatest(acc[f"end{p}"], d["stop"])).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in levels],
        )

    return F.aggregate(order, start, step, lambda acc: F.struct(acc["labels"], acc["n_kept"], acc["miss"]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections, n_suppressed) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    anchored = F.exists(F.array(*map(F.lit, sorted({a for _, _, a, _ in KINDS}))), lambda a: F.contains(F.lower("text"), a))
    gated = rows.withColumn("found", F.when(anchored, detections(F.col("text"))).otherwise(F.array().cast("array<struct<start:int,stop:int,label:string,priority:int,weight:double>>")))
    kept = gated.select("doc_id", F.size("found").alias("n_found"), F.when(F.size("found") > 0, resolved(F.col("found"))).alias("r"), *[c.alias(n) for n, c in base_columns(F.col("text")).items()])
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("r.labels", F.array().cast("array<string>"))))
    missed = F.coalesce("r.miss", F.lit(1.0)) * F.when(F.col("n_base") > 0, 0.5).otherwise(1.0)
    return kept.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), (1 - missed).alias("score"),
        F.col("n_found").alias("n_detections"), (F.col("n_found") - F.coalesce("r.n_kept", F.lit(0))).alias("n_suppressed"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
