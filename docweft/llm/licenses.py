"""License scans by sentence rules. DataFrame functions only.

A text is cut into sentences; those with a word of TRIGGER, which every rule's texts have, are normalised (lower case,
comment signs and punctuation gone, spaces single) and mapped to the identifiers of all sentence rules that fit, in text order; where rules overlap, the one
that begins first and then the earlier rule holds. An SPDX tag with its expression is a sentence of its own and gives an
identifier for each licence of the expression (exceptions after WITH are none); a licence that no rule knows stands as
`spdx:` and its id. A licence name behind a negation ("not under the MIT license") is none. The sequence of identifiers is
read from the left; the first licence rule that fits where it stands names a licence and takes its identifiers;
between a rule's identifiers may stand those of FILLERS, so that an unknown sentence between two clauses does no harm.
SPDX ids name themselves. What is left counts as unmatched; a licence without version or clauses (GENERIC) is not named
beside one of its family that has them. Everything is one projection: no shuffle, no broadcast, memory of one text.

Defined results: a null or empty text has no licences. A sentence that fits no rule is `unknown` if it has a licence word
(WORD), else it does not count. A licence named twice counts once.
Null ids and repeated rows are scanned like any row, texts of any length whole; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: A sentence with such a word is of a licence, known or not.
WORD = r"(?i)licen[cs]|copyright|warrant|permission|redistribut|spdx|public domain|\bas[- ]is\b|\bgpl|creative commons|cc0"
#: Sentences without such a word fit no sentence rule and are not looked at. Between words lies what normalising drops.
_GAP = r"[^\p{L}\p{N}]+"
TRIGGER = WORD + "|" + r"gpl|bsd|wtfpl|misrepresented|plainly marked|this notice may not|subject to the terms|\(c\)|noncommercial|sharealike|noderiv|reserved|endorse|in no event shall|terms of the mit|as is|public domain|creative commons|cc by|apache v?2|under mit\b".replace(" ", _GAP)

#: The GNU licences by name or letters, what lies between a name and its version (no other licence's name), and versions.
_AGPL = r"(?:gnu affero general public license(?: gnu)?(?: agpl)?|\b(?:gnu )?agpl)"
_LGPL = r"(?:gnu (?:lesser|library) general public license(?: gnu)?(?: lgpl)?|\b(?:gnu )?lgpl)"
_GPL = r"(?:gnu general public license(?: gnu)?(?: gpl)?|\b(?:gnu )?gpl)"
_ON = r"(?:(?!gnu |gpl|apache|mozilla|\bmit\b|\bbsd\b|creative commons).)*?"
_LATER = rf"{_ON} or (?:at your option )?(?:any )?later"


def _version(number: str) -> str:
    return rf"(?:(?: licen[cs]es?)?(?: as published by the free software foundation)?(?: either)?(?: the)? ?(?:v|version |ver )?){number}\b"


def _onwards(number: str) -> str:
    """A version further on, with later ones."""
    return rf"(?:{_ON} (?:v|version |ver )| ?v?| license )?{number}\b{_LATER}"


#: Sentence rules over normalised sentences, in order: (identifier, pattern). The last one only looks ahead.
SENTENCES = (
    ("spdx", r"spdx license identifier"),
    ("apache2", r"apache(?: software)? license(?: version| ver)? ?v?2(?: 0)?\b|\bapache ?v?2 0\b(?! \d)(?: license)?|licensed under(?: the)? apache ?v?2\b"),
    ("apacheCopy", r"you may obtain a copy of the license at"),
    ("apacheUse", r"you may not use this (file|work) except in compliance with the license"),
    ("apacheAsIs", r"distributed under the license is distributed on an as is basis"),
    ("agpl3Later", _AGPL + _onwards("3(?: 0)?")),
    ("agpl3", _AGPL + _version("3(?: 0)?")),
    ("lgpl3Later", _LGPL + _onwards("3(?: 0)?")),
    ("lgpl21Later", _LGPL + _onwards("2(?: [01])?")),
    ("lgpl3", _LGPL + _version("3(?: 0)?")),
    ("lgpl21", _LGPL + _version("2(?: [01])?")),
    ("gpl3Later", _GPL + _onwards("3(?: 0)?")),
    ("gpl2Later", _GPL + _onwards("2(?: 0)?")),
    ("gpl3", _GPL + _version("3(?: 0)?")),
    ("gpl2", _GPL + _version("2(?: 0)?")),
    ("gplUnversioned", r"gnu general public license(?: gnu)?(?: gpl)?|\b(?:gnu )?gpl\b"),
    ("mpl2", r"mozilla public license ((v|version) ?)?2 0"),
    ("mpl11", r"mozilla public license ((v|version) ?)?1 1"),
    ("epl2", r"eclipse public license ((v|version) ?)?2 0"),
    ("epl1", r"eclipse public license ((v|version) ?)?1 0"),
    ("eupl12", r"european union public license (eupl )?((v|version) ?)?1 2"),
    ("cddl1", r"common development and distribution license"),
    ("artistic2", r"artistic license ((v|version) ?)?2 0"),
    ("artistic", r"artistic license"),
    ("bslName", r"boost software license( (v|version) ?1 0)?"),
    ("msPl", r"microsoft public license"),
    ("ofl11", r"sil open font license"),
    ("psf2", r"python software foundation license|psf license"),
    ("postgres", r"postgresql license"),
    ("wtfpl", r"do what the f\w* you want to public license|wtfpl"),
    ("zlibName", r"zlib license|zlib libpng license"),
    ("ccZero", r"\bcc0\b|creative commons zero"),
    ("ccByNcNd", r"\bcc by nc nd\b|(creative commons )?attribution noncommercial noderiv"),
    ("ccByNcSa", r"\bcc by nc sa\b|(creative commons )?attribution noncommercial sharealike"),
    ("ccByNc", r"\bcc by nc\b|(creative commons )?attribution noncommercial"),
    ("ccBySa", r"\bcc by sa\b|(creative commons )?attribution sharealike"),
    ("ccByNd", r"\bcc by nd\b|(creative commons )?attribution noderiv"),
    ("ccBy", r"\bcc by\b|creative commons attribution"),
    ("mitName", r"\bmit (?:style )?licenses?\b|under(?: either| both)?(?: the)?(?: terms of)?(?: the)? mit\b|license mit\b|\bexpat license"),
    ("permissionFree", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("noticeIncluded", r"the above copyright notice and this permission notice .*?shall be included"),
    ("asIsProvided", r"the software is provided as is"),
    ("zlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlibOrigin", r"the origin of this software must not be misrepresented"),
    ("zlibAltered", r"altered source versions must be plainly marked"),
    ("zlibNotice", r"this notice may not be removed or altered from any source distribution"),
    ("bslGrant", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("mplForm", r"this source code form is subject to the terms of"),
    ("liability", r"in no event shall the (authors?|copyright)"),
    ("iscGrant", r"permission to use copy modify and( or)? distribute this software for any purpose"),
    ("iscName", r"\bisc license"),
    ("bsdName3", r"\bbsd (?:3|three) clause|\b(?:3|three) clause bsd(?: license)?|\bnew bsd license|\bmodified bsd license|\brevised bsd license"),
    ("bsdName2", r"\bbsd (?:2|two) clause|\b(?:2|two) clause bsd(?: license)?|\bsimplified bsd license|\bfreebsd license"),
    ("bsdName", r"\bbsd license\b"),
    ("bsdGrant", r"redistribution and use in source and binary forms"),
    ("bsdSource", r"redistributions of source code must retain"),
    ("bsdBinary", r"redistributions in binary form must reproduce"),
    ("bsdEndorse", r"neither the name of .*? may be used to endorse or promote"),
    ("bsdAsIs", r"this software is provided by .*? as is"),
    ("unlicense", r"released into the public domain|the unlicense"),
    ("publicDomain", r"public domain"),
    ("allRights", r"all rights reserved"),
    ("copyright", r"^copyright (?=.*\d{4})"),
)

#: A licence's SPDX id, a tag with an expression, and the sentence rules' identifiers of ids in lower case.
_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
_TAG = r"spdx-license-identifier[ \t]*:[ \t]*"
SPDX_TAG = rf"(?i){_TAG}[( \t]*{_ID}(?:[ \t()]+(?:and|or|with)[ \t()]+{_ID})*"
SPDX = (
    ("apache2", r"apache-2\.0"),
    ("agpl3Later", r"agpl-3\.0(-or-later|\+)"),
    ("agpl3", r"agpl-3\.0(-only)?"),
    ("lgpl3Later", r"lgpl-3\.0(-or-later|\+)"),
    ("lgpl3", r"lgpl-3\.0(-only)?"),
    ("lgpl21Later", r"lgpl-2\.1(-or-later|\+)"),
    ("lgpl21", r"lgpl-2\.1(-only)?"),
    ("gpl3Later", r"gpl-3\.0(-or-later|\+)"),
    ("gpl2Later", r"gpl-2\.0(-or-later|\+)"),
    ("gpl3", r"gpl-3\.0(-only)?"),
    ("gpl2", r"gpl-2\.0(-only)?"),
    ("mpl2", r"mpl-2\.0(-no-copyleft-exception)?"),
    ("ccZero", r"cc0-1\.0"),
    *((name, rf"{part}-\d\.\d(-[a-z]+)?") for name, part in (("ccByNcNd", "cc-by-nc-nd"), ("ccByNcSa", "cc-by-nc-sa"), ("ccByNc", "cc-by-nc"), ("ccBySa", "cc-by-sa"), ("ccByNd", "cc-by-nd"), ("ccBy", "cc-by"))),
    ("mitName", "mit"),
    ("iscName", "isc"),
    ("bsdName3", r"bsd-3-clause"),
    ("bsdName2", r"bsd-2-clause"),
    ("unlicense", "unlicense"),
    ("mpl11", r"mpl-1\.1"),
    ("epl2", r"epl-2\.0"),
    ("epl1", r"epl-1\.0"),
    ("eupl12", r"eupl-1\.2"),
    ("cddl1", r"cddl-1\.[01]"),
    ("artistic2", r"artistic-2\.0"),
    ("bslName", r"bsl-1\.0"),
    ("msPl", "ms-pl"),
    ("ofl11", r"ofl-1\.1(-rfn|-no-rfn)?"),
    ("psf2", r"psf-2\.0|python-2\.0"),
    ("postgres", "postgresql"),
    ("wtfpl", "wtfpl"),
    ("zlibName", "zlib"),
)

#: Licence rules over identifier sequences, in order: (licence, its sequences); an identifier with ? may be missing.
LICENCES = (
    ("Apache-2.0", "apache2 apacheUse? apacheCopy? apacheAsIs?"),
    ("AGPL-3.0-or-later", "agpl3Later"),
    ("AGPL-3.0", "agpl3"),
    ("LGPL-3.0-or-later", "lgpl3Later"),
    ("LGPL-3.0", "lgpl3"),
    ("LGPL-2.1-or-later", "lgpl21Later"),
    ("LGPL-2.1", "lgpl21"),
    ("GPL-3.0-or-later", "gpl3Later"),
    ("GPL-2.0-or-later", "gpl2Later"),
    ("GPL-3.0", "gpl3"),
    ("GPL-2.0", "gpl2"),
    ("GPL", "gplUnversioned"),
    ("MPL-2.0", "mplForm? mpl2"),
    ("MPL-1.1", "mpl11"),
    ("EPL-2.0", "epl2"),
    ("EPL-1.0", "epl1"),
    ("EUPL-1.2", "eupl12"),
    ("CDDL-1.0", "cddl1"),
    ("Artistic-2.0", "artistic2"),
    ("Artistic", "artistic"),
    ("MS-PL", "msPl"),
    ("OFL-1.1", "ofl11"),
    ("PSF-2.0", "psf2"),
    ("PostgreSQL", "postgres"),
    ("WTFPL", "wtfpl"),
    ("CC0-1.0", "ccZero"),
    ("CC-BY-NC-ND", "ccByNcNd"),
    ("CC-BY-NC-SA", "ccByNcSa"),
    ("CC-BY-NC", "ccByNc"),
    ("CC-BY-SA", "ccBySa"),
    ("CC-BY-ND", "ccByNd"),
    ("CC-BY", "ccBy"),
    ("BSL-1.0", "bslName? bslGrant asIsProvided? liability?", "bslName"),
    ("Zlib", "zlibName? zlibGrant zlibOrigin? zlibAltered? zlibNotice?", "zlibName"),
    ("MIT", "mitName? permissionFree noticeIncluded? asIsProvided? liability?", "mitName"),
    ("ISC", "iscName? iscGrant noticeIncluded? asIsProvided? liability?", "iscName"),
    ("BSD-3-Clause", "bsdName3? bsdGrant bsdSource bsdBinary bsdEndorse bsdAsIs? liability?", "bsdName3"),
    ("BSD-2-Clause", "bsdName2? bsdGrant bsdSource bsdBinary bsdAsIs? liability?", "bsdName2"),
    ("BSD", "bsdName", "bsdGrant"),
    ("Unlicense", "unlicense"),
    ("Public-Domain", "publicDomain"),
)
#: Identifiers that may stand between those of a rule, and licences that are not named beside another of their family.
FILLERS = ("unknown", "copyright", "allRights", "spdx")
GENERIC = (("GPL", "GPL-"), ("BSD", "BSD-"), ("Artistic", "Artistic-"), ("Public-Domain", "Unlicense"))

#: A negation with what may stand between it and the licence's name.
_NEGATED = r"\b(?:not|never|no longer|nor|isn t|aren t|wasn t|don t|doesn t|didn t|cannot|can t|won t|instead of|rather than|other than|incompatible with)(?: (?:yet|be|been|being|is|are|licensed|released|available|distributed|covered|published|offered|provided|governed|made|under|by|with|the|a|an|of|terms|to|subject|compatible|any|version|use|uses|used|using|apply|adopt|accept|choose)){0,8} "
#: The sentence rules that are names of licences.
_NAMES = tuple(n for n, _ in SENTENCES if n in {i for i, _ in SPDX} | {"gplUnversioned", "bsdName", "artistic"})


def sequence_pattern(rule: tuple[str, ...]) -> str:
    """A rule's sequences as a pattern over ` id id `."""
    filler = rf"(?: (?:{'|'.join(FILLERS)})(?= ))*+"

    def one(sequence: str) -> str:
        # Optional names at the start stand right before what follows; the first identifier that must be there anchors the rest.
        parts, anchored = [], False
        for token in sequence.split():
            name = token.rstrip("?")
            part = f"{filler} {name}" if anchored else f" {name}{filler}" if token.endswith("?") else f" {name}"
            anchored = anchored or not token.endswith("?")
            parts.append(f"(?:{part})?" if token.endswith("?") else part)
        return "".join(parts)

    return f"(?:{'|'.join(one(x) for x in rule)})(?= )"


SENTENCE_END = r"(?<=[.!?])(?<!\b[vV]\.)(?<!\b[vV]er\.)\s+|\n[\s#*/;-]*\n"


def sentences(text: Column) -> Column:
    """Sentences with a word of TRIGGER: cut after an end mark (not that of "v.") with white space behind it, at empty lines, and around SPDX tags."""
    apart = F.regexp_replace(text, rf"({SPDX_TAG})", "\n\n$1\n\n")
    return F.filter(F.split(apart, SENTENCE_END), lambda s: F.rlike(s, F.lit(TRIGGER)))


#: Licences that MIT is named beside without the word: `MIT or Apache-2.0`, `GPL-2.0 and MIT`.
_BESIDE = r"(?:apache|agpl|lgpl|gpl|bsd|isc|mpl|mozilla)"


def normalised(sentence: Column) -> Column:
    """Lower case, words alone, American spelling, `+` behind a version spelt out, and `mit` beside another licence as the mit license."""
    plain = F.regexp_replace(F.replace(F.lower(sentence), F.lit("(c)"), F.lit(" copyright ")), r"(?<=\d)\+", " or any later ")
    plain = F.regexp_replace(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), r"\b((?:sub|re|un)?)licence", "$1license")
    plain = F.regexp_replace(plain, rf"\bmit (?=(?:and|or)(?: the)? {_BESIDE})", "mit license ")
    return F.regexp_replace(plain, rf"\b({_BESIDE}(?: \w+){{0,3}} (?:and|or)(?: the)? )mit\b(?! (?:style )?license)", "$1mit license")


def _first(text: Column, rules: tuple[tuple[str, str], ...], other: Column) -> Column:
    """The identifier of the first rule that all of text fits."""
    out = F.when(F.rlike(text, F.lit(rf"^(?:{rules[0][1]})$")), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(F.rlike(text, F.lit(rf"^(?:{pattern})$")), name)
    return out.otherwise(other)


def spdx_identifiers(tag: Column) -> Column:
    """Identifiers of the licences of an SPDX tag; an id without a capital or digit, NONE and NOASSERTION name no licence."""
    ids = F.split(F.regexp_replace(F.regexp_replace(tag, rf"(?i)^\s*{_TAG}[( \t]*", ""), rf"(?i)[ \t()]+with[ \t()]+{_ID}", ""), r"(?i)[ \t()]+(?:and|or)[ \t()]+")
    other = lambda x: F.when(F.rlike(x, F.lit(r"[A-Z0-9]")) & ~F.upper(x).isin("NONE", "NOASSERTION"), F.concat(F.lit("spdx:"), x)).otherwise(F.lit("spdx"))
    return F.transform(ids, lambda x: _first(F.lower(x), SPDX, other(x)))


def identifiers(sentence: Column) -> Column:
    """The identifiers of all sentence rules that a sentence fits, in text order; unknown after them for a sentence with a licence word."""
    plain = F.regexp_replace(normalised(sentence), _NEGATED + "(?:" + "|".join(f"(?:{p})" for n, p in SENTENCES if n in _NAMES) + ")", " ")
    parts = F.regexp_extract_all(plain, F.lit("|".join(f"(?:{p})" for _, p in SENTENCES)), F.lit(0))
    by_rules = F.transform(parts, lambda x: _first(x, SENTENCES[:-1], F.lit(SENTENCES[-1][0])))
    found = F.when(F.rlike(sentence, F.lit(rf"^\s*(?:{SPDX_TAG})\s*$")), spdx_identifiers(F.trim(sentence))).otherwise(by_rules)
    return F.concat(found, F.when(F.rlike(sentence, F.lit(WORD)), F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>")))


def _named(matches: Column) -> Column:
    """The licences of stretches of identifiers that some licence rule fits, in rule order, each once, without generic ones beside their family."""

    def number(x: Column) -> Column:
        fits = [F.rlike(x, F.lit(f"^{sequence_pattern(tuple(rule))} $")) for _, *rule in LICENCES]
        return reduce(lambda case, k: case.when(fits[k], k), range(1, len(fits)), F.when(fits[0], 0))

    names = F.array(*(F.lit(name) for name, *_ in LICENCES))
    found = F.transform(F.array_sort(F.array_distinct(F.transform(matches, lambda m: number(F.concat(m, F.lit(" ")))))), lambda k: F.get(names, k))
    beside = lambda x, all_of: [(x == name) & F.exists(all_of, lambda y: y.startswith(family)) for name, family in GENERIC]  # noqa: B023, E731
    # A lambda's variable stands for the array, so that it is written and computed once.
    return F.transform(F.array(found), lambda xs: F.filter(xs, lambda x: ~reduce(or_, beside(x, xs))))[0]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licences (in rule order, then other SPDX ids, comma-joined), sentence_ids (in text order, space-joined), n_sentences, n_unmatched of every row."""
    text = text_of(text_col)
    none = F.array().cast("array<array<string>>")
    each = F.when(F.rlike(text, F.lit(TRIGGER)), F.transform(sentences(text), identifiers)).otherwise(none)
    rows = df.select(F.col(id_col), F.filter(each, lambda x: F.size(x) > 0).alias("each"))
    rows = rows.select(id_col, F.size("each").cast("long").alias("n_sentences"), F.flatten(F.transform("each", lambda x: F.when(x[0] != "unknown", F.array_remove(x, "unknown")).otherwise(x))).alias("ids"))
    every = "|".join(sequence_pattern(tuple(rule)) for _, *rule in LICENCES)
    line = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    own = F.transform(F.array_distinct(F.filter("ids", lambda x: x.startswith("spdx:"))), lambda x: F.substring(x, F.lit(6), F.length(x)))
    left = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, every, " "), r" spdx:\S+(?= )", " "), " +", " "))
    licences = F.array_join(F.concat(_named(F.regexp_extract_all(line, F.lit(every), F.lit(0))), own), ",")
    quiet = F.size("ids") == 0
    rows = rows.select(id_col, F.when(quiet, F.lit("")).otherwise(licences).alias("licences"), F.array_join("ids", " ").alias("sentence_ids"), "n_sentences", F.when(quiet, F.lit("")).otherwise(left).alias("left"))
    return rows.select(id_col, "licences", "sentence_ids", "n_sentences", F.when(F.col("left") == "", 0).otherwise(F.size(F.split("left", " "))).cast("long").alias("n_unmatched"))
