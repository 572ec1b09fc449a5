"""License detection by ordered signature rules over the words of a text.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered; a rule is a regular expression
over the words joined by single blanks, so line ends, punctuation and comment marks do not matter.
Every rule names the words it cannot match without, for each way of writing it ("gpl|gpl2": one of both).
A vectorised look at all words finds the texts that hold the required words of any rule, and only these
rules run on only these texts.

Rules come in priorities: 5 license bodies and tags, 4 full grants, 3 statements, 2 bare names, 1
families.  Overlaps are resolved in order of priority, then length: a detection inside the interval of
one kept before it (of its own or a higher priority) is suppressed, so "gnu general public license
version 3" does not also report the family.

Base phrases (`PHRASES`) are counted at every place, whatever the rules say; their labels always stay.
The score is 1 minus the chance that all detections err, each erring with chance 0.5^priority.

A null or empty text has no words and no labels.  Repeated rows are scanned alike; extra columns are
ignored.  Whole texts are scanned.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tagloom.llm import words as W

#: counted at every place: words and label
PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}

#: names: label, required words, the name as it is written (in joined words)
NAMES = [
    ("mit", "mit", r"(?:the )?mit(?: expat)? licen[cs]e"),
    ("mit", "expat", r"(?:the )?expat licen[cs]e"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[cs]e)?"),
    ("x11", "x11", r"(?:the )?x11 licen[cs]e"),
    ("apache-1", "apache", r"(?:the )?apache(?: software)? licen[cs]e(?: version)? 1(?: [01])?"),
    ("apache-2", "apache|apache2", r"(?:the )?apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?(?: licen[cs]e)?"),
    ("bsd-2", "bsd|freebsd", r"(?:the )?(?:simplified bsd(?: licen[cs]e)?|freebsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?|(?:2|two) clause bsd(?: licen[cs]e)?)"),
    ("bsd-3", "bsd", r"(?:the )?(?:new bsd licen[cs]e|modified bsd licen[cs]e|revised bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?|(?:3|three) clause bsd(?: licen[cs]e)?)"),
    ("bsd-4", "bsd", r"(?:the )?(?:original bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?|(?:4|four) clause bsd(?: licen[cs]e)?)"),
    ("bsd-0", "bsd|0bsd", r"(?:zero clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)?"),
    ("isc", "isc", r"(?:the )?isc licen[cs]e"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng|png reference", r"(?:the )?(?:png reference library|libpng) licen[cs]e(?: version 2)?"),
    ("gpl-1", "gnu", r"(?:the )?gnu (?:general public licen[cs]e|gpl)(?: version| v)? ?1(?: 0)?"),
    ("gpl-2", "gnu", r"(?:the )?gnu (?:general public licen[cs]e|gpl)(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "gnu", r"(?:the )?gnu (?:general public licen[cs]e|gpl)(?: version| v)? ?3(?: 0)?"),
    ("gpl-2", "gplv2", r"gplv2(?: 0)?"),
    ("gpl-3", "gplv3", r"gplv3(?: 0)?"),
    ("gpl-2", "gpl|gpl2", r"(?<!l)(?<!a)gpl(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "gpl|gpl3", r"(?<!l)(?<!a)gpl(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2", "gnu", r"(?:the )?gnu (?:lesser|library) general public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2.1", "gnu", r"(?:the )?gnu lesser general public licen[cs]e(?: version| v)? ?2 1"),
    ("lgpl-3", "gnu", r"(?:the )?gnu lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.1", "lgpl|lgpl2", r"lgpl(?: version| v)? ?2 1"),
    ("lgpl-3", "lgpl|lgpl3", r"lgpl(?: version| v)? ?3(?: 0)?"),
    ("lgpl-3", "lgplv3", r"lgplv3"),
    ("agpl-3", "affero", r"(?:the )?(?:gnu )?affero general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "agpl|agpl3", r"agpl(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "agplv3", r"agplv3"),
    ("gfdl", "gnu", r"(?:the )?gnu free documentation licen[cs]e(?:(?: version| v)? ?1 [123])?"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public licen[cs]e(?: version| v)? ?1 1"),
    ("mpl-2", "mozilla", r"(?:the )?mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("mpl-2", "mpl|mpl2", r"mpl(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", r"(?:the )?eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", r"(?:the )?eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("edl-1", "eclipse", r"(?:the )?eclipse distribution licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("cddl-1", "cddl|cddl1", r"(?:common development and distribution licen[cs]e )?cddl(?: version| v)? ?1(?: [01])?"),
    ("cpl-1", "common", r"(?:the )?common public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("eupl", "european", r"(?:the )?european union public licen[cs]e(?:(?: version| v)? ?1 [12])?"),
    ("eupl", "eupl|eupl1", r"eupl(?:(?: version| v)? ?1 [12])?"),
    ("artistic-1", "artistic", r"(?:the )?artistic licen[cs]e(?: version)? 1(?: 0)?"),
    ("artistic-2", "artistic", r"(?:the )?artistic licen[cs]e(?: version)? 2(?: 0)?"),
    ("boost-1", "boost", r"(?:the )?boost software licen[cs]e(?:(?: version)? 1(?: 0)?)?"),
    ("python-2", "python", r"(?:the )?python software foundation licen[cs]e(?:(?: version)? 2(?: 0)?)?"),
    ("php-3", "php", r"(?:the )?php licen[cs]e(?: version)? 3(?: 0| 01)?"),
    ("ruby", "ruby", r"(?:the )?ruby(?: s)? licen[cs]e"),
    ("openssl", "openssl", r"(?:the )?openssl licen[cs]e"),
    ("postgresql", "postgresql", r"(?:the )?postgresql licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl"),
    ("ofl-1.1", "sil", r"(?:the )?sil open font licen[cs]e(?:(?: version)? 1 1)?"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal licen[cs]e"),
    ("ecl-2", "educational", r"(?:the )?educational community licen[cs]e(?:(?: version)? 2(?: 0)?)?"),
    ("afl-3", "academic", r"(?:the )?academic free licen[cs]e(?:(?: version)? 3(?: 0)?)?"),
    ("osl-3", "open", r"(?:the )?open software licen[cs]e(?:(?: version)? 3(?: 0)?)?"),
    ("odbl", "open", r"(?:the )?open (?:data commons open )?database licen[cs]e"),
    ("odc-by", "attribution", r"(?:the )?open data commons attribution licen[cs]e"),
    ("pddl", "domain", r"(?:the )?(?:open data commons )?public domain dedication and licen[cs]e"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc", r"cc by(?! (?:nc|sa|nd))(?: [1234] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?! (?:sa|nd))(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by", "commons", r"creative commons attribution(?: [1234] [05])?(?: international)?(?! (?:non|share|no ))(?: licen[cs]e)?"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: [1234] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?! (?:share|no))(?: [1234] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?(?: international)?(?: licen[cs]e)?"),
]
#: how a name is used: priority, required words besides the name's, expression around the name
FORMS = [
    (5, "spdx license identifier", r"spdx license identifier {}"),
    (4, "under", r"(?:licen[cs]ed|released|distributed|available|published|redistributed|provided|covered|shared|dual licensed)"
                 r"(?: to you)? under (?:the terms (?:and conditions )?of )?{}"),
    (3, "see", r"see (?:the )?(?:file )?(?:{}|licen[cs]e (?:file )?for {})"),
    (3, "governed", r"governed by (?:the terms of )?{}"),
    (2, "", r"{}"),
]
#: bodies and statements of their own: priority, label, required words, expression
SIGNATURES = [
    (5, "mit", "permission hereby granted deal", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
                                                r"(?: the software)? to deal in the software without restriction"),
    (5, "isc", "permission hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (5, "bsd", "redistribution binary forms", r"redistribution and use in source and binary forms with or without modification are permitted provided that"),
    (5, "bsd-3", "endorse promote", r"neither the name of [a-z0-9 ]{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    (5, "bsd-4", "advertising acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    (5, "zlib", "altered misrepresented", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (5, "apache-2", "licenses apache", r"www apache org licenses licen[cs]e 2 0"),
    (5, "gpl", "redistribute gnu", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (5, "lgpl", "library redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    (5, "gpl-2", "gnu published either", r"gnu general public license as published by the free software foundation either version 2 of the license"),
    (5, "gpl-3", "gnu published either", r"gnu general public license as published by the free software foundation either version 3 of the license"),
    (5, "agpl-3", "affero", r"gnu affero general public license as published by the free software foundation either version 3"),
    (5, "mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    (5, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    (5, "wtfpl", "just what want", r"you just do what the f[a-z]+ you want to"),
    (5, "boost-1", "organization accompanying", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    (5, "cc0", "publicdomain", r"creativecommons org publicdomain zero 1 0"),
    (5, "cc-by", "creativecommons", r"creativecommons org licenses by [1234] [05]"),
    (5, "cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1234] [05]"),
    (5, "cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1234] [05]"),
    (5, "cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1234] [05]"),
    (5, "cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1234] [05]"),
    (5, "cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1234] [05]"),
    (3, "gpl-later", "later option", r"version [123] (?:0 )?(?:of the license )?or at your option any later version"),
    (3, "public-domain", "domain", r"(?:released|placed|dedicated|donated) (?:in|into|to) the public domain"),
    (3, "proprietary", "reserved", r"all rights reserved"),
    (3, "proprietary", "confidential", r"proprietary and confidential"),
    (3, "no-commercial-use", "commercial|noncommercial", r"(?:for|only) non ?commercial use(?: only)?"),
    (2, "copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    (1, "gpl", "gnu", r"(?:the )?gnu (?:general public licen[cs]e|gpl)"),
    (1, "lgpl", "gnu", r"(?:the )?gnu (?:lesser|library) general public licen[cs]e"),
    (1, "agpl", "affero", r"affero general public licen[cs]e"),
    (1, "apache", "apache", r"apache(?: software)? licen[cs]e"),
    (1, "mpl", "mozilla", r"mozilla public licen[cs]e"),
    (1, "bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    (1, "creative-commons", "commons", r"creative commons licen[cs]e"),
]
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
SEPARATORS[65:91] = False  # upper case is lowered, not a border


@lru_cache(maxsize=1)
def rules() -> list[tuple[int, str, tuple[frozenset[str], ...], re.Pattern]]:
    """Priority, label, required words of each way of writing, expression; the order decides ties."""
    out = []
    for priority, label, required, body in SIGNATURES:
        out.append((priority, label, tuple(frozenset(w.split()) for w in required.split("|")), re.compile(rf"(?<!\S)(?:{body})(?!\S)")))
    for label, required, name in NAMES:
        for priority, more, form in FORMS:
            words = tuple(frozenset(w.split()) | frozenset(more.split()) for w in required.split("|"))
            out.append((priority, label, words, re.compile(rf"(?<!\S)(?:{form.replace('{}', name)})(?!\S)")))
    return sorted(out, key=lambda r: -r[0])


@lru_cache(maxsize=1)
def _gate() -> tuple[np.ndarray, list[str], dict[str, list[int]]]:
    """Hashes of all required words (sorted), the words in that order, and the rules by their rarest word."""
    everyday = {"under", "see", "common", "open", "mit", "library", "later", "forms", "deal", "gnu", "license", "identifier", "just", "what", "want",
                "option", "published", "either", "reference"}
    needed = sorted({w for _, _, ways, _ in rules() for words in ways for w in words}, key=W.hash_text)
    anchor: dict[str, list[int]] = {}
    for i, (_, _, ways, _) in enumerate(rules()):
        for at in sorted({min(words, key=lambda w: (w in everyday, -len(w), w)) for words in ways}):
            anchor.setdefault(at, []).append(i)
    return np.array([W.hash_text(w) for w in needed], np.uint64), needed, anchor


def resolved(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Detections (priority, start, end, label) that no kept one of their own or higher priority contains."""
    kept: list[tuple[int, int, int, str]] = []
    starts: list[int] = []
    ends: list[int] = []  # largest end among kept ones up to each start
    for priority in sorted({f[0] for f in found}, reverse=True):
        reach, fresh = -1, []
        for f in sorted((f for f in found if f[0] == priority), key=lambda f: (f[1], -f[2])):
            at = bisect.bisect_right(starts, f[1]) - 1
            if f[2] > reach and not (at >= 0 and ends[at] >= f[2]):
                fresh.append(f)
            reach = max(reach, f[2])
        kept += fresh
        spans = sorted((f[1], f[2]) for f in kept)
        starts = [s for s, _ in spans]
        ends = np.maximum.accumulate([e for _, e in spans]).tolist()
    return kept


def detect(words: list[str], present: set[str]) -> list[tuple[int, int, int, str]]:
    """Resolved detections as (priority, first word, end word, label)."""
    _, _, anchor = _gate()
    todo = {i for w in present for i in anchor.get(w, ()) if any(words <= present for words in rules()[i][2])}
    if not todo:
        return []
    joined = " ".join(words)
    begins = np.cumsum([0] + [len(w) + 1 for w in words])
    found = []
    for i in sorted(todo):
        priority, label, _, pattern = rules()[i]
        for m in pattern.finditer(joined):
            found.append((priority, int(np.searchsorted(begins, m.start())), int(np.searchsorted(begins, m.end())), label))
    return resolved(found)


_RESULT = StructType([
    StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()),
    StructField("last_word", LongType()), StructField("base_labels", StringType()), StructField("labels", StringType()),
    StructField("score", DoubleType()), StructField("detections", StringType())])


def scan_block(block: W.Block) -> list[tuple]:
    found = W.words(block, lower=True, separators=SEPARATORS)
    text, h = found.text_of(), found.hashes
    base: list[list[tuple[int, str]]] = [[] for _ in range(block.texts)]
    for phrase, label in PHRASES.items():
        k = len(phrase)
        if len(h) < k:
            continue
        hit = text[:len(h) - k + 1] == text[k - 1:]
        for i, w in enumerate(phrase):
            hit = hit & (h[i:len(h) - k + 1 + i] == np.uint64(W.hash_text(w)))
        for at in np.flatnonzero(hit).tolist():
            base[text[at]].append((at - int(found.bounds[text[at]]), label))
    hashes, needed, anchor = _gate()
    spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    hits = np.flatnonzero(hashes[spot] == h)
    pairs = np.unique(text[hits] * len(hashes) + spot[hits]).tolist()
    present: dict[int, set[str]] = {}
    for p in pairs:
        present.setdefault(p // len(hashes), set()).add(needed[p % len(hashes)])
    rows = []
    for i in range(block.texts):
        low, high = int(found.bounds[i]), int(found.bounds[i + 1])
        spans: list[tuple[int, int, int, str]] = []
        here = present.get(i, set())
        if any(words <= here for w in here for r in anchor.get(w, ()) for words in rules()[r][2]):
            raw = block.data[block.offsets[i]:block.offsets[i + 1]].tobytes()
            shift = int(block.offsets[i])
            words = [raw[s - shift:e - shift].decode(errors="replace").translate(_LOWER)
                     for s, e in zip(found.starts[low:high].tolist(), found.ends[low:high].tolist(), strict=True)]
            spans = detect(words, here)
        names = {label for _, label in base[i]}
        places = [at for at, _ in base[i]]
        doubt = 0.5 ** (sum(s[0] for s in spans) + 3 * len(places))
        rows.append((high - low, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names)),
                     ",".join(sorted(names | {s[3] for s in spans})), 1.0 - doubt,
                     ";".join(f"{label}@{s}-{e}" for _, s, e, label in sorted(spans, key=lambda x: (x[1], x[2], x[3])))))
    return rows


_LOWER = {c: c + 32 for c in range(65, 91)}


def scan(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id`` and the fields of `_RESULT`; ``detections`` lists label@first-end in words."""
    def run(texts: pa.Array) -> pa.Array:
        rows = [r for block in W.blocks(texts) for r in scan_block(block)]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        cols = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _RESULT.names)
    return docs.select("doc_id", arrow_udf(run, _RESULT)(F.col("text")).alias("r")).select("doc_id", "r.*")
