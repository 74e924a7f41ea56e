"""License scans by ordered signature rules, in DataFrame and SQL functions only.

Hundreds of regular expressions stand in an ordered table. A rule is tried on a text only if its keyword occurs there, with any white space between its words; a text
without any keyword is passed over after a few substring tests. Every match is an interval with a tier (3: text of a license's own, or a tag; 2: a full
name with version; 1: a loose mention). An interval that lies inside another of the same or a higher tier is suppressed, so "gnu general public
license version 3" is one detection and not four.

Defined cases: a null text is empty; matches are leftmost and do not overlap per rule; of equal intervals the higher tier stays, then the
earlier rule; without a match labels is '' and score 0; repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyeol.llm.common import ascii_lower

#: label, keyword, name (regex over lower-cased text), versions
FAMILIES = [
    ("mit", "mit", "(?:the )?mit(?:/x11)?", []),
    ("mit", "expat", "(?:the )?expat(?:/x11)?", []),
    ("mit", "x11", "(?:the )?x11(?:/x11)?", []),
    ("apache", "apache", "(?:the )?apache(?: software)?(?: foundation)?", ["1.0", "1.1", "2.0"]),
    ("gpl", "general public", "(?:the )?(?:gnu )?general public", ["1", "2", "3"]),
    ("gpl", "gpl", "(?:the )?(?:gnu )?gpl", ["1", "2", "3"]),
    ("lgpl", "lesser general", "(?:the )?(?:gnu )?lesser general public", ["2.1", "3"]),
    ("lgpl", "library general", "(?:the )?(?:gnu )?library general public", ["2"]),
    ("lgpl", "lgpl", "(?:the )?(?:gnu )?lgpl", ["2", "2.1", "3"]),
    ("agpl", "affero", "(?:the )?(?:gnu )?affero general public", ["1", "3"]),
    ("agpl", "agpl", "(?:the )?(?:gnu )?agpl", ["1", "3"]),
    ("gfdl", "free documentation", "(?:the )?(?:gnu )?free documentation", ["1.1", "1.2", "1.3"]),
    ("bsd", "bsd", "(?:the )?(?:new |modified |simplified |revised |original )?(?:[0234][ -]clause )?bsd", []),
    ("mpl", "mozilla", "(?:the )?mozilla public", ["1.0", "1.1", "2.0"]),
    ("mpl", "mpl", "(?:the )?mpl", ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse", "(?:the )?eclipse public", ["1.0", "2.0"]),
    ("edl", "eclipse distribution", "(?:the )?eclipse distribution", ["1.0"]),
    ("cddl", "common development", "(?:the )?common development and distribution", ["1.0", "1.1"]),
    ("cpl", "common public", "(?:the )?common public", ["1.0"]),
    ("ipl", "ibm public", "(?:the )?ibm public", ["1.0"]),
    ("artistic", "artistic", "(?:the )?(?:perl )?artistic", ["1.0", "2.0"]),
    ("isc", "isc", "(?:the )?isc", []),
    ("isc", "internet systems consortium", "(?:the )?internet systems consortium", []),
    ("zlib", "zlib", "(?:the )?zlib(?:/libpng)?", []),
    ("libpng", "libpng", "(?:the )?libpng", ["2"]),
    ("unlicense", "unlicense", "(?:the )?unlicense", []),
    ("wtfpl", "do what the fuck", "(?:the )?do what the fuck you want to public", ["1", "2"]),
    ("cc0", "cc0", "(?:the )?(?:creative commons )?cc0", ["1.0"]),
    ("cc-by", "attribution", "(?:the )?(?:creative commons |cc )attribution", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-sa", "sharealike", "(?:the )?(?:creative commons |cc )attribution[ -]sharealike", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc", "noncommercial", "(?:the )?(?:creative commons |cc )attribution[ -]noncommercial", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nd", "noderiv", "(?:the )?(?:creative commons |cc )attribution[ -]noderiv(?:ative)?s", ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("bsl", "boost", "(?:the )?boost software", ["1.0"]),
    ("busl", "business source", "(?:the )?business source", ["1.0", "1.1"]),
    ("sspl", "server side", "(?:the )?server side public", ["1"]),
    ("elastic", "elastic", "(?:the )?elastic", ["1.0", "2.0"]),
    ("eupl", "european union public", "(?:the )?european union public", ["1.0", "1.1", "1.2"]),
    ("ms-pl", "microsoft public", "(?:the )?microsoft public", []),
    ("ms-rl", "microsoft reciprocal", "(?:the )?microsoft reciprocal", []),
    ("odbl", "open database", "(?:the )?open (?:data commons )?(?:open )?database", ["1.0"]),
    ("odbl", "open data commons database", "(?:the )?open data commons database", ["1.0"]),
    ("odc-by", "open data commons", "(?:the )?open data commons attribution", ["1.0"]),
    ("ofl", "open font", "(?:the )?(?:sil )?open font", ["1.0", "1.1"]),
    ("osl", "open software", "(?:the )?open software", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", "academic free", "(?:the )?academic free", ["1.1", "2.0", "2.1", "3.0"]),
    ("python", "python", "(?:the )?python(?: software foundation)?", ["2"]),
    ("php", "php", "(?:the )?php", ["3.0", "3.01"]),
    ("ruby", "ruby", "(?:the )?ruby", []),
    ("w3c", "w3c", "(?:the )?w3c(?: software(?: notice and)?)?", []),
    ("openssl", "openssl", "(?:the )?openssl", []),
    ("vim", "vim", "(?:the )?vim", []),
    ("postgresql", "postgresql", "(?:the )?postgresql", []),
    ("ncsa", "ncsa", "(?:the )?(?:university of illinois/)?ncsa(?: open source)?", []),
    ("qpl", "q public", "(?:the )?q public", ["1.0"]),
    ("rpl", "reciprocal public", "(?:the )?reciprocal public", ["1.1", "1.5"]),
    ("upl", "universal permissive", "(?:the )?universal permissive", ["1.0"]),
    ("unicode", "unicode", "(?:the )?unicode(?: data files and software)?", []),
    ("zpl", "zope", "(?:the )?zope public", ["1.1", "2.0", "2.1"]),
    ("blueoak", "blue oak", "(?:the )?blue oak model", ["1.0.0"]),
    ("mulan", "mulan", "(?:the )?mulan (?:psl|permissive software)", ["1", "2"]),
    ("cecill", "cecill", "(?:the )?cecill", ["1.0", "2.0", "2.1"]),
    ("openrail", "openrail", "(?:the )?(?:creativeml |bigscience |bigcode )?openrail(?:-m|\\+\\+)?", []),
]
SPDX = """mit apache-2.0 apache-1.1 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.0 lgpl-2.1
lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later bsd-2-clause bsd-3-clause bsd-4-clause 0bsd
mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cddl-1.1 artistic-1.0 artistic-2.0 isc zlib unlicense wtfpl cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0
cc-by-nc-4.0 cc-by-nd-4.0 bsl-1.0 busl-1.1 sspl-1.0 elastic-2.0 eupl-1.2 ms-pl ms-rl odbl-1.0 ofl-1.1 osl-3.0 afl-3.0 python-2.0 php-3.01 w3c openssl vim
postgresql ncsa qpl-1.0 upl-1.0 zpl-2.1 blueoak-1.0.0 mulanpsl-2.0 cecill-2.1""".split()
#: label, keyword, regex: words of a license's own
BODIES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "without restriction", r"deal in the software without restriction, including without limitation"),
    ("mit", "as is", r"the software is provided [\"“']?as is[\"”']?, without warranty of any kind"),
    ("isc", "permission to use, copy", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd", "neither the name", r"neither the name of [^.]{1,80} nor the names of (?:its|any) contributors"),
    ("apache", "apache.org/licenses", r"https?://www\.apache\.org/licenses/license-2\.0"),
    ("apache", "apache license", r"licensed under the apache license, version 2\.0"),
    ("gpl", "redistribute it", r"redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it", r"redistribute it and/or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute it", r"redistribute it and/or modify it under the terms of the gnu affero general public license"),
    ("gpl", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/gpl"),
    ("lgpl", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/lgpl"),
    ("agpl", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/agpl"),
    ("mpl", "mozilla.org/mpl", r"https?://(?:www\.)?mozilla\.org/mpl"),
    ("mpl", "source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in)?to? ?the public domain"),
    ("cc-by-sa", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-sa/[0-9.]+"),
    ("cc-by-nc", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc/[0-9.]+"),
    ("cc-by-nd", "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nd/[0-9.]+"),
    ("cc-by", "creativecommons.org", r"https?://creativecommons\.org/licenses/by/[0-9.]+"),
    ("cc0", "creativecommons.org", r"https?://creativecommons\.org/publicdomain/zero/[0-9.]+"),
    ("zlib", "arising from the use", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl", "boost.org", r"https?://www\.boost\.org/license_1_0\.txt"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?[0-9]{4}(?:[-–, ]+[0-9]{4})*"),
]
#: Parts of the short names of Creative Commons licenses, after "by".
SHORT = ["", "sa", "nc", "nd", "nc sa", "nc nd"]
#: A text without any of these (or a short name of Creative Commons) has no match of any rule. They are single words, since a line may end between two.
GATES = ["licen", "copyright", "domain", "reserved", "permission", "redistribut", "neither", "gnu.org", "mozilla.org", "creativecommons.org", "boost.org", "apache.org", "arising", "provided", "restriction", "unencumbered"]


def spaced(regex: str) -> str:
    """The regex with a run of white space wherever it has a space."""
    to = {" ": r"\s++", " ?": r"\s*+", " *": r"\s*+", "[ -]": r"(?:\s++|-)"}
    return re.sub(r"\[[^\]]*\]| [?*]?", lambda m: to.get(m[0], m[0].replace(" ", r"\s")), regex)


def rules() -> list[dict]:
    """The ordered table: id, label, keyword, regex, tier (1 to 3), weight. Keywords have single spaces; they are looked up with white space folded."""
    out: list[dict] = []
    add = lambda label, key, regex, tier, weight: out.append({"id": len(out), "label": label, "key": key, "rx": spaced(regex), "tier": tier, "weight": weight})
    for label, key, regex in BODIES:
        add(label, key, regex, 3 if label not in ("copyright", "proprietary") else 1, 0.95 if label not in ("copyright", "proprietary") else 0.2)
    for tag in SPDX:
        stem = tag.split("-")[0] if not tag.startswith("cc-") else "-".join(x for x in tag.split("-") if not x[0].isdigit())
        add({"0bsd": "bsd", "mulanpsl": "mulan"}.get(stem, stem if stem != "ms" else tag), tag, r"spdx-license-identifier:? *" + tag.replace(".", r"\.") + r"(?![a-z0-9.-])", 3, 0.99)
    word = r"(?![\p{L}\p{N}])"
    for label, key, name, versions in FAMILIES:
        name = r"(?<![\p{L}\p{N}])" + name
        lic = r",? (?:open source )?licen[sc]e"
        for v in versions:
            add(label, key, name + lic + r"s?,? \(?(?:version |ver\. |v\.? ?)?" + v.replace(".", r"\.") + r"(?![0-9.]*[0-9])", 2, 0.9)
        add(label, key, r"(?:released|licensed|distributed|available|provided|covered|published)(?: [\p{L}]+){0,3} under (?:the terms of |a |an )?" + name.replace(r"(?<![\p{L}\p{N}])", "") + lic + word, 2, 0.9)
        add(label, key, r"licen[sc]ed? ?[:=] ?[\"']?" + name.replace(r"(?<![\p{L}\p{N}])", "") + word, 2, 0.8)
        add(label, key, name + r"[ -]licen[sc](?:e|ed)s?" + word, 1, 0.6)
    edge, under = r"(?<![\p{L}\p{N}])", r"(?:released|licensed|distributed|available|provided|covered|published)(?: [\p{L}]+){0,3} under (?:the terms of )?(?:the |a |an )?"
    version = r"(?:[ -](?:version |ver\. |v\.? ?)?(?:1\.0|2\.0|2\.5|3\.0|4\.0)(?![0-9.]*[0-9]))"
    for parts in SHORT:
        label = "-".join(["cc-by", *parts.split()])
        for key, start in (("cc by", "cc by"), ("cc-by", "cc-by"), ("creative commons by", "creative commons by")):
            name = start + "".join(f"[ -]{x}" for x in parts.split()) + r"(?![ -](?:sa|nc|nd)(?![\p{L}\p{N}]))"
            add(label, key, edge + name + version, 2, 0.9)
            add(label, key, under + name + version + "?" + word, 2, 0.9)
            add(label, key, r"licen[sc]ed? ?[:=] ?[\"']?" + name + version + "?" + word, 2, 0.8)
            # "cc by" alone may be about a letter
            add(label, key, edge + name + (r"(?:[ -]licen[sc](?:e|ed)s?)?" if parts or key != "cc by" else r"[ -]licen[sc](?:e|ed)s?") + word, 1, 0.6)
    return out


def _rules_column() -> Column:
    return F.from_json(F.lit(json.dumps(rules())), "array<struct<id:int,label:string,key:string,rx:string,tier:int,weight:double>>")


def detections(lowered: str = "low") -> Column:
    """array<struct<s,e,tier,label,weight>> of the matches that stay, by start."""
    rule = f"""flatten(transform(array(regexp_replace({lowered}, r'\\s+', ' ')), folded -> transform(filter(rules, r -> contains(folded, r.key) AND {lowered} RLIKE r.rx), r -> named_struct('r', r,
        'f', regexp_extract_all({lowered}, r.rx, 0), 'p', split({lowered}, r.rx, -1)))))"""
    hits = f"""flatten(transform({rule}, h -> aggregate(zip_with(h.f, slice(h.p, 1, size(h.f)), (f, p) -> named_struct('f', f, 'p', p)),
        named_struct('at', 0, 'out', cast(array() AS array<struct<s:int,ne:int,nt:int,id:int,label:string,weight:double>>)),
        (a, x) -> named_struct('at', a.at + char_length(x.p) + char_length(x.f), 'out', array_append(a.out, named_struct('s', a.at + char_length(x.p),
            'ne', -(a.at + char_length(x.p) + char_length(x.f)), 'nt', -h.r.tier, 'id', h.r.id, 'label', h.r.label, 'weight', h.r.weight))), a -> a.out)))"""
    # by start, longest first, highest tier first: an interval is inside an earlier one if that one's end is not before its own
    return F.expr(f"""aggregate(array_sort({hits}),
        named_struct('m', array(-1, -1, -1), 'keep', cast(array() AS array<struct<s:int,e:int,tier:int,label:string,weight:double>>)),
        (a, h) -> named_struct('m', transform(a.m, (x, t) -> if(t + 1 = -h.nt, greatest(x, -h.ne), x)),
            'keep', if(exists(slice(a.m, -h.nt, 4 + h.nt), x -> x >= -h.ne), a.keep, array_append(a.keep, named_struct('s', h.s, 'e', -h.ne, 'tier', -h.nt, 'label', h.label, 'weight', h.weight)))),
        a -> a.keep)""")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, low (lower-cased text) and hits, the detections of the rules."""
    df = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains("low", F.lit(g))
    gate = gate | F.col("low").rlike(r"(?:cc|commons)[\s-]+by")
    none = F.array().cast("array<struct<s:int,e:int,tier:int,label:string,weight:double>>")
    df = df.withColumn("rules", F.when(gate, _rules_column()))
    return df.withColumn("hits", F.when(gate, detections()).otherwise(none)).drop("rules")


PLACE = """transform(filter(sequence(0, size(w) - 1), i -> w[i] = 'license' AND (get(w, i - 1) IN ('mit', 'apache') OR get(w, i - 1) = 'public' AND get(w, i - 2) = 'general')),
    i -> named_struct('at', if(w[i - 1] = 'public', i - 2, i - 1), 'label', CASE w[i - 1] WHEN 'mit' THEN 'mit' WHEN 'apache' THEN 'apache' ELSE 'gpl' END))"""


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    df = scan(docs).withColumn("w", F.array_remove(F.split("low", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), ""))
    df = df.withColumn("base", F.when(F.contains("low", F.lit("license")), F.expr(PLACE)).otherwise(F.array().cast("array<struct<at:int,label:string>>")))
    names = lambda c: F.array_sort(F.array_distinct(c))
    base, own = F.transform("base", lambda x: x["label"]), F.transform("hits", lambda x: x["label"])
    return df.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["at"])).cast("long").alias("last_word"),
        F.array_join(names(base), ",").alias("base_labels"),
        F.array_join(names(F.concat(base, own)), ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 0.9).otherwise(0.0), F.coalesce(F.array_max(F.transform("hits", lambda x: x["weight"])), F.lit(0.0))).alias("score"),
        F.size("hits").cast("long").alias("n_detections"),
    )
