"""Text functions as column expressions: cleaning, identifiers, sections, chunks, keyword scores, intents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and their ASCII forms.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("–", "-"), ("—", "-"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'))

# Words that carry no meaning in a query.
STOP_WORDS = (
    "a", "an", "the", "of", "in", "and", "or", "for", "to", "with", "on", "is", "are", "was", "were", "what", "how", "does", "do", "can", "could", "my", "about", "me", "i", "tell",
    "explain", "describe", "know", "between", "their", "there", "this", "that", "it", "its", "be", "been", "have", "has", "had", "which", "who", "from", "by", "at", "as", "not",
    "but", "if", "so", "than", "very", "most", "more", "also", "any", "all", "each", "some", "would", "should", "will", "may", "might",
)

# Words that no citation key begins with.
KEY_STOP_WORDS = ("a", "an", "the", "of", "in", "on", "and", "or", "for", "to", "with", "from", "into", "via", "by")

# The first rule with a fragment in the heading names the section.
SECTION_RULES = (
    ("abstract", ("abstract",)),
    ("related_work", ("related work", "literature review", "prior work", "previous work")),
    ("background", ("background", "preliminaries", "preliminar")),
    ("introduction", ("introduction", "intro")),
    ("methods", ("method", "approach", "model", "algorithm", "framework", "architecture", "technique", "implementation")),
    ("experiments", ("experiment", "experimental setup", "setup", "evaluation", "evaluation setup", "evaluation methodology")),
    ("results", ("result", "finding", "performance", "ablation")),
    ("discussion", ("discussion", "analysis")),
    ("limitations", ("limitation", "threat to validity", "future work")),
    ("conclusion", ("conclusion", "conclud", "summary", "closing")),
    ("acknowledgements", ("acknowledg", "thanks", "funding")),
    ("appendix", ("appendix", "supplementary", "supplement")),
)

# Phrases that tell how a paper is cited.
SUPPORT_PHRASES = (
    "consistent with", "in agreement with", "confirms", "confirm", "supports", "support", "demonstrates", "validate", "corroborate", "replicate", "align with", "in line with", "extends", "extend",
    "builds on", "build on", "builds upon", "following", "based on", "as shown by", "as demonstrated by", "provides evidence", "further supports", "echoes", "reinforces", "converges",
    "is consistent", "corroborating", "substantiates", "replicating", "corroborated by", "well established", "widely accepted",
)
CONTRADICT_PHRASES = (
    "contradicts", "contrary to", "in contrast", "unlike", "challenges", "challenge", "disputes", "dispute", "inconsistent with", "questions", "whereas", "on the other hand", "however,", "but found",
    "but suggest", "fails to", "does not support", "do not support", "cannot be explained", "alternative", "differ from", "revises", "cast doubt", "at odds with", "incompatible", "not fully",
    "problematic for", "instead of", "rather than", "contends", "refutes", "rebuts", "incompatible with", "calls into question", "has been criticized",
)
MENTION_PHRASES = (
    "see also", "e.g.,", "i.e.,", "for a review", "reviewed by", "proposed by", "introduced by", "developed by", "defined by", "according to", "as described", "as noted", "as discussed",
    "the method of", "the approach of", "the framework of", "first described", "originally proposed", "classically", "summarized by", "surveyed by", "for example",
)

_LEADING_NUMBER = r"^\s*(?:\d+(?:\.\d+)*|[IVXLCDM]+|\([a-z]\))(?=[\s\.\):]|$)\s*[\.\):]?\s*"
MATH_LINE = r"""^[\s\d+\-*/=()\[\]{}^|_<>,.;:'"\\~`@#%&]+$"""


def without_ligatures(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), LIGATURES, text)


def clean(text: Column) -> Column:
    """Ligatures spelled out, white space collapsed, anything beyond printable ASCII dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_ligatures(text), r"\s+", " "), r"[^\x20-\x7E\n]", ""))


def doi(text: Column) -> Column:
    """The first DOI, without punctuation around it; empty if none has twelve characters."""
    found = F.btrim(F.regexp_extract(text, r"10\.\d{4,9}/[^\s\"'<>\[\]{},;]+", 0), F.lit(".,;:)("))
    return F.when(F.length(found) >= 12, found).otherwise("")


def section_type(heading: Column) -> Column:
    """The kind of section a heading names, its numbering aside."""
    low = F.trim(F.lower(F.regexp_replace(heading, _LEADING_NUMBER, "")))
    rules = [(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), name) for name, words in SECTION_RULES]
    return reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1])).otherwise("other")


def chunks(text: Column, size: int = 400, overlap: int = 80) -> Column:
    """Overlapping runs of words; those of 60 characters and fewer go."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " ")), lambda c: F.length(c) > 60)


def without_equations(text: Column) -> Column:
    """Lines of symbols go: very short ones, those of few letters, those of mathematics only. Empty lines stay."""
    s = F.trim
    letters = lambda l: F.length(F.regexp_replace(l, r"[^\p{L}]", ""))
    keep = lambda l: (s(l) == "") | ((F.length(s(l)) > 4) & (letters(s(l)) >= F.length(s(l)) * 0.35) & ~s(l).rlike(MATH_LINE))
    return F.array_join(F.transform(F.filter(F.split(text, "\n"), keep), lambda l: F.when(s(l) == "", "").otherwise(l)), "\n")


def keyword_score(query: str, title: Column, abstract: Column) -> Column:
    """Share of the query's words (half), of its word pairs (a quarter) and of its words in the title (a quarter)."""
    words = [w for w in query.lower().split() if w not in STOP_WORDS]
    if not words:
        return F.lit(0.0)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    low = F.lower(title)
    text = F.concat(low, F.lit(" "), F.lower(abstract))
    hits = lambda where, what: reduce(lambda a, b: a + b, [F.contains(where, F.lit(w)).cast("int") for w in what], F.lit(0))
    n = float(len(words))
    return F.least(F.lit(1.0), hits(text, words) / n * 0.5 + hits(text, pairs) / float(max(len(pairs), 1)) * 0.25 + hits(low, words) / n * 0.25)


def citation_intent(context: Column) -> Column:
    """Struct (intent, confidence) by counted phrases; support wins ties over contradiction, that over mention."""
    low = F.lower(context)
    count = lambda phrases: reduce(lambda a, b: a + b, [F.contains(low, F.lit(p)).cast("int") for p in phrases])
    s, c, n = count(SUPPORT_PHRASES), count(CONTRADICT_PHRASES), count(MENTION_PHRASES)
    best = F.greatest(s, c, n)
    kind = F.when(s == best, "supports").when(c == best, "contradicts").otherwise("mentions")
    short = context.isNull() | (F.length(F.trim(context)) < 10) | (best == 0)
    return F.struct(F.when(short, "mentions").otherwise(kind).alias("intent"), F.when(short, F.lit(0.30)).otherwise(F.least(F.lit(0.90), 0.45 + best * 0.12)).alias("confidence"))


def resolved_year(year: Column, abstract: Column) -> Column:
    """The year if plausible, else one in parentheses near the text's start, else any plausible one there."""
    quoted = F.regexp_extract(F.substring(abstract, 1, 250), r"\((\d{4})\)", 1).try_cast("int")
    plain = F.regexp_extract(F.substring(abstract, 1, 300), r"\b(19[5-9]\d|20[0-2]\d)\b", 1).try_cast("int")
    return F.coalesce(F.when(year.between(1900, 2030), year), F.when(quoted.between(1950, 2030), quoted), plain)


def safe_filename(title: Column, paper_id: Column) -> Column:
    kept = F.trim(F.substring(F.regexp_replace(title, r"[^A-Za-z0-9 _-]+", ""), 1, 80))
    name = F.regexp_replace(kept, r"\s+", "_")
    return F.concat(F.when(name == "", paper_id).otherwise(name), F.lit("_"), F.substring(paper_id, 1, 10), F.lit(".pdf"))


def citation_key(authors: Column, year: Column, title: Column) -> Column:
    """First author's surname, year, first meaningful word of the title."""
    last = F.lower(F.regexp_replace(F.element_at(F.split(F.try_element_at(authors, F.lit(1)), " "), -1), "[^A-Za-z]", ""))
    words = F.filter(F.regexp_extract_all(F.lower(title), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*KEY_STOP_WORDS))
    return F.concat(F.when(F.coalesce(last, F.lit("")) == "", "anon").otherwise(last), F.coalesce(year.cast("string"), F.lit("nd")), F.coalesce(F.get(words, F.lit(0)), F.lit("")))


def bibliography_escaped(text: Column) -> Column:
    steps = (("\\", ""), ("{", "("), ("}", ")"), ("&", "\\&"), ("%", "\\%"))
    return F.trim(reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), steps, text))


def entry_type(venue: Column) -> Column:
    low = F.lower(venue)
    meeting = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ("proceedings", "conference", "workshop", "symposium")])
    return F.when(venue == "", "misc").when(meeting, "inproceedings").otherwise("article")


# Patterns of journal noise, removed in this order; (?i) where letter case does not matter.
NOISE = (
    r"^[A-Za-z][A-Za-z\s,&]+\d{1,4}\s*\(\d{4}\)\s*[\d\-–]+\s*",
    r"(?i)Contents\s+lists?\s+available\s+at\s+\S+",
    r"(?i)journal\s+homepage\s*:?\s*\S+",
    r"(?i)Available\s+online\s+at\s+\S+",
    r"https?://doi\.org/\S+",
    r"(?i)doi\s*:\s*10\.\S+",
    r"https?://\S+",
    r"www\.\S+",
    r"\d{4}[-~/]\d{3}[\dxX][\S]*",
    r"\$\d+\.\d{2}\S*",
    r"(?i)Vol\.\s*\d+\s*,?\s*No\.\s*\d+[^.]*",
    r"(?i)pp\.\s*\d+\s*[-–]\s*\d+",
    r"(?i)Elsevier\s*(B\.V\.|Science|Ltd)?|Pergamon(\s+Press)?|Academic\s+Press|Springer[-\s]Verlag|Cambridge\s+University\s+Press|Wiley[-\s]Liss",
    r"©\s*\d{4}[^.]*\.?",
    r"(?i)Received\s+\w+\s+\d+.*?(?:Accepted|Published)\s+\w+\s+\d+[^.]*\.?",
    r"(?i)This\s+article\s+was\s+download\w*[^.]*\.?",
    r"(?i)Article\s+in\s+press",
    r"(?i)Proc\.\s*Natl\.\s*Acad\.\s*Sci\.\s*USA\s*Vol\.\s*\d+,?\s*pp\.\s*\d+[-–]\d+,?\s*(?:January|February|March|April|May|June|July|August|September|October|November|December)?\s*\d{0,4}",
    r"(?i)^(?:The\s+)?(?:Journal\s+of\s+\w[\w\s,]+|Psychological\s+(?:Review|Bulletin|Science)|Neuroscience|Cogniti\w+\s+Psychology|Annual\s+Review\s+of\s+\w+)[\s,]*\d{4}[^A-Za-z]*",
    r"\b[A-Z]{4,}\b\s*",
    r"(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s*\d{4}",
)

# What a query that asks for a kind of argument says.
INTENTS = {
    "evolution": r"(?i)\b(?:evolv|evolution|histor|how\s+has|changed|changing|progress|over\s+time|temporal|decades?|timeline|early|later|recent|traditional|modern)\b",
    "convergence": r"(?i)\b(?:agree|agreement|consensus|converg|support|consistent|replicated|robust|established|confirmed|evidence\s+for)\b",
    "tension": r"(?i)\b(?:conflict|disagree|debate|tension|contradict|competing|controversial|challenge|opposing|different\s+view|vs\.?\s|versus|dispute)\b",
    "gap": r"(?i)\b(?:gap|missing|lack|future|open\s+question|unresolved|unclear|unknown|unexplored|understudied|not\s+yet|limited)\b",
    "synthesis": r"(?i)\b(?:synthesiz|integrat|combin|bridge|multiple|different\s+approaches?|cross[-\s]disciplin|connect|link|relationship\s+between)\b",
}

# Damaged characters and what they were, and quotes with their ASCII forms.
MOJIBAKE = (("â€™", "’"), ("â€œ", "“"), ("â€\u009d", "”"), ("â€“", "—"), ("â€”", "–"), ("â€¦", "…"), ("Â ", " "))
PLAIN_QUOTES = (("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("—", "--"), ("–", "-"), ("…", "..."))


def without_noise(text: Column) -> Column:
    """Publisher and journal phrases removed, white space collapsed."""
    stripped = reduce(lambda t, p: F.regexp_replace(t, p, ""), NOISE, without_ligatures(text))
    return F.trim(F.regexp_replace(stripped, r"\s{2,}", " "))


def _held(value: Column, use) -> Column:
    """``use(value)``, the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


_MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
# What the line of a journal or publisher, taken for a title, looks like; (?i) where letter case does not matter.
HEADER_LINES = (
    r"^\s*$",
    r"^\s*[A-Za-z][\w\s,]+\d{1,4}\s*\(\d{4}\)",
    _MONTHS + r"\s+\d{1,2},?\s*\d{4}",
    r"^\s*\d{4}[-~/]\d{3}[\dxX]",
    r"\$\d+\.\d{2}",
    r"(?i)\bVol\.\s*\d+|\bProc\.\s*Natl",
    r"(?i)^\s*(?:Psychological|Cognitive|Journal|Annual)\s+\w+\s+\d{4}",
)


def is_header(title: Column) -> Column:
    """Whether a title is rather a line of the journal, or blank."""
    return reduce(lambda a, b: a | b, [title.rlike(p) for p in HEADER_LINES])


FIRST_CHUNK = r"^(.{15,180}?)(?:\.\s|$)"


def _first_chunk(abstract: Column, quiet: Column) -> Column:
    chunk = F.regexp_extract(quiet, FIRST_CHUNK, 1)
    found = F.when(chunk != "", F.trim(chunk)).otherwise(F.trim(F.substring(quiet, 1, 150)))
    return F.when((F.length(abstract) < 30) | (F.length(quiet) < 15), "").otherwise(found)


def recovered_title(abstract: Column) -> Column:
    """What may be the title in an abstract with journal noise: its first chunk without the noise; empty if it is short."""
    return _held(without_noise(abstract), lambda quiet: _first_chunk(abstract, quiet))


def query_variants(title: Column, abstract: Column) -> Column:
    """Texts to look a paper up by, the best first, of equal beginnings (50 characters, in either case) the first."""
    title, abstract = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    parts = F.array(abstract, F.substring(abstract, 81, 300), F.substring(abstract, 121, 300), title)

    def variants(quiet: Column) -> Column:
        garbled, long = is_header(title), F.length(abstract)
        found = _first_chunk(abstract, quiet[0])
        return F.array(
            *[F.when((long > least) & (F.length(quiet[i]) > 40), F.substring(quiet[i], 1, 250)) for i, least in enumerate((40, 120, 200))],
            F.when(garbled & (F.length(found) > 15), F.substring(found, 1, 200)),
            F.when(~garbled & (F.length(title) > 15) & (F.length(quiet[3]) > 15), F.substring(quiet[3], 1, 200)),
            F.when(F.length(title) > 20, F.substring(title, 1, 200)),
        )

    beginning = lambda v: F.lower(F.trim(F.substring(v, 1, 50)))
    all_ = _held(F.transform(parts, without_noise), lambda quiet: F.array_compact(variants(quiet)))
    return _held(all_, lambda vs: _held(F.transform(vs, beginning), lambda keys: F.filter(vs, lambda v, i: F.array_position(keys, beginning(v)) == i + 1)))


def intent_boosts(query: Column) -> Column:
    """Map of argument kind to 3.0 where the query asks for it, else 1.0."""
    return F.create_map(*[x for kind, p in INTENTS.items() for x in (F.lit(kind), F.when(query.rlike(p), 3.0).otherwise(1.0))])


def repaired(text: Column) -> Column:
    """Known damaged sequences put right, quotes and dashes in ASCII, C1 control characters dropped."""
    fixed = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), MOJIBAKE + PLAIN_QUOTES, text)
    return F.regexp_replace(fixed, "[\\x{80}-\\x{9f}]", "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


# What marks a sentence as the journal's or the publisher's.
METADATA_MARKERS = (
    "sciencedirect", "elsevier", "homepage", "doi.org", "doi:", "issn", "copyright", "downloaded", "contents list", "journal homepage", "available online", "article in press",
    "printed in u.s.a", "email:", "[your email]", "correspondence concerning", "author note", "rspa.royalsociety", "citethisarticle",
)


def readable(sentence: Column, least: int = 5) -> Column:
    """Whether a sentence is prose: long enough, mostly letters, without publishers' phrases and words run together."""
    low = F.lower(sentence)
    letters = F.length(F.regexp_replace(sentence, r"[^\p{L}]", ""))
    joined = lambda w: (F.length(w) > 12) & F.substring(w, 2, 1_000_000).rlike(r"\p{Lu}")
    blob = lambda w: (F.length(w) > 15) & (F.lower(w) == w) & w.rlike(r"\p{L}")
    listed = lambda w: (F.length(w) > 10) & F.contains(w, F.lit(","))
    marked = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in METADATA_MARKERS])

    def prose(words: Column) -> Column:
        n = F.size(words)
        return (n >= least) & (F.size(F.filter(words, joined)) <= F.greatest(F.lit(1.0), n * 0.25)) & ~F.exists(words, lambda w: blob(w) | listed(w))

    words = F.filter(F.split(sentence, r"\s+"), lambda w: w != "")
    return F.coalesce((F.length(sentence) >= 20) & (letters / F.nullif(F.length(sentence), F.lit(0)) >= 0.55) & ~marked & _held(words, prose), F.lit(False))


# What is no prose in the text of a page, each blanked in this order; (?i) where letter case does not matter.
DISPLAY_NOISE = (
    r"[A-Za-z]+\d{1,4}\s*\(\d{4}\)\s*[\d\-–]+\s*",
    r"[A-Za-z]+\s+\d{1,4}\s*\(\d{4}\)\s*[\d\-–]+\s*",
    r"(?i)contents?\s*lists?\s*available\s*at\s*\S+",
    r"(?i)journal\s*homepage\s*:?\s*\S+",
    r"(?i)Available\s+online\s+at\s+\S+",
    r"https?://\S+",
    r"www\.\S+",
    r"(?i)doi\s*:?\s*10\.\S+",
    r"(?i)E-mail\s*:\s*\S+",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.\S+",
    r"\d{4}[-~/]\d{3}[\dxX]\S*",
    r"\$\d+\.\d{2}\S*",
    r"(?i)Vol\.\s*\d+\s*,?\s*No\.\s*\d+[^.]*",
    r"(?i)pp\.\s*\d+\s*[-–]\s*\d+",
    r"(?i)Elsevier\s*(B\.V\.|Science|Ltd)?|Pergamon(\s+Press)?|Academic\s+Press|Springer[-\s]Verlag|Cambridge\s+University\s+Press|Wiley[-\s]Liss",
    r"©\s*\d{4}[^.]*\.?",
    r"(?i)Copyright\s+.{0,40}Society\s+\w+",
    r"(?i)Printed\s+in\s+\S+",
    r"(?i)\bARTICLE\s+IN\s+PRESS\b",
    r"Behavioral/\w+/\w+",
    r"\b[A-Z]{5,}\b",
    r"(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s*\d{4}",
    r"(?i)^(?:The\s+)?(?:Journal\s+of\s+[\w\s,]+|Cognitive\s+Psychology|Neuropsychologia|Psychological\s+(?:Review|Bulletin|Science))[\s,]*(?:\d{4}|Vol\.)",
    r"(?i)Contentslistsavailable\S*",
    r"(?i)journalhomepage\S*",
    r"(?i)a\s+r\s+t\s+i\s+c\s+l\s+e\s+i\s+n\s+f\s+o",
    r"(?i)a\s+b\s+s\s+t\s+r\s+a\s+c\s+t",
    r"(?i)k\s+e\s+y\s+w\s+o\s+r\s+d\s+s",
    r"(?i)Email\s*:\s*\S+",
    r"\[[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\]",
    r"(?i)Author\s+Note\b[^.]{0,300}\.?",
    r"(?i)Correspondence\s+concerning\b[^.]{0,300}\.?",
    r"(?:[A-Z]+\s+){3,}\d+\b",
    r"(?i)published\s*:\s*\d+\s*\w+\s*\d{4}",
    r"(?i)[a-z]+-\d+-\d+\s+\w+\d+,?\d*\s+Time:\d+:\d+\s*#\d+",
    r"(?i)\bORIGINALRESEARCH\b|\bOriginal\s+Research\b",
    r"(?i)doi:\s*10\.\d{4,}/\S+",
    r"(?i)\w+\.\w+publishing\.\w+",
    r"(?i)Cite\s*this\s*article\s*:.*",
    r"(?i)(?:Accepted|Received)\d+\w+\d{4}",
    r"(?i)(?:Articlehistory|Article\s*history)\s*:",
    r"\bAbstract\b",
    r"\b[a-z]{16,}\b",
    r"\b[a-z][a-z-]{20,}\b",
    r"\b\w*[a-z][A-Z]\w{4,}\b",
    r"\b[A-Z][a-z]+[A-Z][a-z]*'[A-Z][a-z]+\b",
    r"\b\w+[a-z][A-Z]\w*'\w*\b",
    r",\s*[A-Z]{2,5}\d*\s*,\s*[A-Za-z]+",
    r"(?i),\s*(?:USA|UK|Australia|Canada|Germany|France|China|Japan)\b",
)
CHARACTER_CODES = r"\(cid:\d+\)"


def displayed(text: Column) -> Column:
    """The prose of a page's text: damage repaired, publishers' phrases and words run together blanked, white space collapsed."""
    plain = F.regexp_replace(without_ligatures(repaired(text)), CHARACTER_CODES, "")
    quiet = reduce(lambda t, p: F.regexp_replace(t, p, " "), DISPLAY_NOISE, plain)
    return F.trim(F.regexp_replace(quiet, r"\s{2,}", " "))


# How a sentence opens that makes a claim, and one that tells a result.
CLAIM_OPENERS = (
    r"(?i)(?:we|this study|this paper|this work|our|here,?\s+we|results?|findings?|data|analysis|evidence|the\s+present)\s+"
    r"(?:show|find|demonstrate|propose|report|present|argue|suggest|reveal|found|showed|demonstrated|reported|observed|identified|indicates?|suggests?)\s+(?:that\s+)?"
)
FINDING_OPENERS = (
    r"(?i)(?:we\s+(?:found|observed|showed|demonstrated|report)|results?\s+(?:show|indicate|suggest|reveal|demonstrate)|"
    r"our\s+(?:results?|findings?|analysis)\s+(?:show|indicate|suggest)|here\s+we)"
)
NO_CLAIM, NO_FINDING = "investigates key aspects of the research question", "contributes important evidence to this area"

# What a claim never holds.
CLAIM_JUNK = (
    r"(?i)email|@|\[your|\[last\s+name\]|\[university",
    r"(?i)university|department|princeton|callaghan|newcastle|institute|division|semel|los\s+angeles",
    r"[A-Z][a-z]+\s*,\s*,",
    r"^investigates key aspects",
    r"(?i)^(?:cognitive\s+psychology|neuropsychologia|psychological\s+(?:review|bulletin|science)|journal\s+of|neuroscience|annual\s+review|quarterly\s+journal|psychonomic\s+bulletin|biology\s+&?\s*philosophy)",
    r"(?i)\bjournal\s+of\s+\w+",
    r"(?i)\b(?:quarterly|bulletin|proceedings)\s+(?:of|and)\b",
    r"\b[a-z]{3,10}\s+[a-z]\.?\s*$",
    r"\w+'\s*$",
    r"(?i)^(?:of|and|or|the|in|on|for|to|a|an)\s+\d+\s+",
    r"^\d+\s+",
)

# What is cut from a title that stands for a claim, in this order, and what comes in its place.
TITLE_CUTS = (
    (r"^(?:[A-Z]+\s+){3,}\d+\s*", ""),
    (r"(?i)^(?:The\s+)?Journal\s+of\s+(?:[A-Z]\w+\s+){1,4}", ""),
    (r"(?i)^(?:Cognitive\s+Psychology|Neuropsychologia|Psychological\s+(?:Review|Bulletin|Science)|Psychology|Neuroscience|Mathematics|Physics|Annual\s+Review\s+of\s+\w+)\s*", ""),
    (r"(?i)^(?:The|A|An)\s+", ""),
    (r"(?i)\s+(?:Department|Division|Institute|School)\s+of\b.*", ""),
    (r"\s+\[.*", ""),
    (r"(?i)\s+Autho\b.*", ""),
    (r"\b\w*[a-z][A-Z]\w{4,}\b", " "),
    (r"\b[a-z]{16,}\b", " "),
    (r"\s{2,}", " "),
)
OUTER_SPACE, CLOSING_MARKS = r"^\s+|\s+$", r"[.,;:]+$"


def plausible_claim(text: Column) -> Column:
    """Whether a fragment reads as a claim: no affiliation, list of names, journal or words run together."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    blob = lambda w: (F.length(w) > 25) & w.rlike(r"^-*\p{L}[\p{L}-]*$")
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    junk = reduce(lambda a, b: a | b, [text.rlike(p) for p in CLAIM_JUNK])
    return (F.length(text) >= 15) & ~junk & _held(words, lambda w: ~F.exists(w, blob) & (commas <= F.greatest(F.lit(2.0), F.size(w) * 0.3)))


def title_as_claim(title: Column) -> Column:
    """A title without headers, journals and affiliations, cut at a word to 90 characters, in lower case; null if it is short."""
    strip = lambda t: F.regexp_replace(t, OUTER_SPACE, "")
    short = reduce(lambda t, p: strip(F.regexp_replace(t, *p)), TITLE_CUTS, strip(title))
    cut = _held(short, lambda t: F.when(F.length(t) > 90, F.regexp_replace(F.substring(t, 1, 90), " [^ ]*$", "")).otherwise(t))
    return _held(cut, lambda t: F.when(F.length(t) > 10, F.lower(t)))


def _first_plausible(fragments: Column) -> Column:
    return F.get(F.filter(fragments, plausible_claim), F.lit(0))


def _told(prose: Column, openers: str, longest: int) -> Column:
    """What the sentences say after an opener, where that is more than 20 characters."""
    after = F.transform(F.filter(prose, lambda s: s.rlike(openers)), lambda s: F.substring(F.regexp_extract(s, f"{openers}(?s:\\s*(.*))", 1), 1, longest))
    return F.transform(F.filter(after, lambda s: F.length(s) > 20), lambda s: F.concat(F.regexp_replace(F.lower(s), CLOSING_MARKS, ""), F.lit("...")))


def _whole(sentence: Column, least: int, longest: int) -> Column:
    cut = F.substring(sentence, 1, longest)
    return F.when(F.length(cut) > least, F.regexp_replace(F.lower(cut), CLOSING_MARKS, ""))


def prose(text: Column) -> Column:
    """The readable sentences of a page's text."""
    return F.filter(sentences(displayed(text)), lambda s: readable(s))


def main_claim(sentences: Column, title: Column) -> Column:
    """What readable ``sentences`` claim: after an opener, else the second, else the first, else the title."""
    found = F.concat(_told(sentences, CLAIM_OPENERS, 110), F.array_compact(F.array(_whole(F.get(sentences, F.lit(1)), 25, 110), _whole(F.get(sentences, F.lit(0)), 20, 110))))
    return F.coalesce(_first_plausible(found), title_as_claim(title), F.lit(NO_CLAIM))


def key_finding(sentences: Column, title: Column) -> Column:
    """What readable ``sentences`` found: after an opener beyond the first sentence, else the last sentence, else the title."""
    found = F.concat(_told(F.slice(sentences, 2, 1_000_000_000), FINDING_OPENERS, 90), F.array_compact(F.array(_whole(F.try_element_at(sentences, F.lit(-1)), 20, 90))))
    return F.coalesce(_first_plausible(found), title_as_claim(title), F.lit(NO_FINDING))


def relevant_sentence(text: Column, terms: list[str], least: float = 0.08) -> Column:
    """The sentence that holds the largest share of the terms, the first of equals; null under ``least``."""
    words = lambda s: F.array_distinct(F.split(F.lower(s), r"[^a-z0-9]+"))
    asked = F.array(*[F.lit(t) for t in terms])
    scored = F.transform(sentences(text), lambda s, i: F.struct((F.size(F.array_intersect(words(s), asked)) / float(max(len(terms), 1))).alias("share"), (-i).alias("place"), s.alias("sentence")))
    best = F.array_max(scored)
    return F.when(best["share"] > least, best["sentence"])


def short_author(authors: Column) -> Column:
    first = F.try_element_at(authors, F.lit(1))
    last = F.when(F.contains(first, F.lit(",")), F.trim(F.substring_index(first, ",", 1))).otherwise(F.element_at(F.split(first, " "), -1))
    return F.when(F.size(authors) > 1, F.concat(last, F.lit(" et al."))).when(F.size(authors) == 1, last).otherwise("the authors")


# Title words too common to tell a paper by.
GENERIC_TITLE_WORDS = ("study", "analysis", "method", "model", "theory", "approach", "using", "toward", "beyond", "neural", "based", "novel", "improved", "unified", "general", "framework")


def title_mention(abstract: Column, title: Column) -> Column:
    """The part of an abstract around the first three telling words of another paper's title; null if they are not there."""
    words = F.filter(F.split(title, r"\s+"), lambda w: (F.length(w) > 4) & ~F.lower(w).isin(*GENERIC_TITLE_WORDS))
    fragment = F.lower(F.array_join(F.slice(words, 1, 3), " "))
    at = F.position(fragment, F.lower(abstract))
    start = F.greatest(F.lit(0), at - 1 - 150)
    return F.when((F.length(title) > 10) & (fragment != "") & (at > 0), F.substring(abstract, start + 1, at - 1 + 200 - start))


def abstract_of(text: Column) -> Column:
    """What stands between the word abstract and the next section, 1200 characters at most; else the first 500."""
    found = F.regexp_extract(text, r"(?is)abstract[:\s]+(.*?)\n\s*(?:introduction|keywords|1[.\s]|background)", 1)
    return F.when(found != "", F.substring(clean(found), 1, 1200)).otherwise(F.substring(clean(text), 1, 500))


def inverted_to_text(inverted: Column) -> Column:
    """Map of word to positions, as a text: words by position, then by word."""
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda s: s["w"]), " "), F.lit(""))
