"""Column functions over titles, identifiers, queries, URLs and citations. All of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OPERATORS = ["AND", "OR", "NOT"]
# How each source joins terms.
AND_WORD = ["arxiv", "europe_pmc", "core", "pubmed"]
SPACE_FOR_OR = ["dblp", "openalex", "crossref", "semantic_scholar"]
NO_BOOLEAN = ["semantic_scholar", "dblp", "crossref", "openalex"]
# Words that end a candidate phrase.
STOPWORDS = (
    "a an the and or but of to in on for with about as at by from into over after is are be been being this that these those it its i you we they he she "
    "want like know learn research researching study studying understand find looking look interested topic topics paper papers would could should can will "
    "my me more some how what which their regarding related using use used based techniques technique methods method"
).split()
# Addresses of code repositories, hosts and phrases that tell of a dataset.
GITHUB = r"https?://(?:www\.)?github\.com/([A-Za-z0-9\-_.]+/[A-Za-z0-9\-_.]+)"
GITLAB = r"https?://(?:www\.)?gitlab\.com/([A-Za-z0-9\-_.]+(?:/[A-Za-z0-9\-_.]+)+)"
DATASET_HOSTS = r"zenodo\.org|figshare\.com|huggingface\.co/datasets|kaggle\.com/datasets|dataverse\.harvard\.edu|data\.mendeley\.com|osf\.io"
DATASET_PHRASES = (
    r"dataset\s+(?:is\s+)?(?:available|released|provided|can\s+be\s+(?:found|downloaded))|data\s+(?:is\s+)?(?:available|released|provided)\s+(?:at|from|on|via)"
    r"|publicly\s+available\s+data|supplementary\s+data|benchmark\s+dataset"
)
DATASET = f"(?i)(?:{DATASET_HOSTS}|{DATASET_PHRASES})"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Column | str) -> Column:
    """Null where a string is empty."""
    return F.nullif(col(x), F.lit(""))


def truthy(x: Column | str, kind: str) -> Column:
    """Null where a value counts as missing: 0, '', false, an empty list."""
    x = col(x)
    if kind == "string":
        return F.when(x != "", x)
    if kind == "boolean":
        return F.when(x, x)
    return F.when(F.size(x) > 0, x) if kind.startswith("array") else F.when(x != 0, x)


def label(x: Column | str) -> Column:
    """Null for '' and the string None."""
    return F.when(~col(x).isin("", "None"), col(x))


# --- identifiers and titles -------------------------------------------------------------------------------------------


def norm_doi(x: Column | str) -> Column:
    return F.trim(F.lower(F.regexp_replace(col(x), r"(?i)^https?://(?:dx\.)?doi\.org/", "")))


def norm_arxiv(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"v[0-9]+$", ""))


def norm_title(x: Column | str) -> Column:
    """Lower case, only a-z, 0-9 and spaces; inner spaces stay, other scripts leave ''."""
    return F.trim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9 ]", ""))


def paper_key() -> Column:
    return F.coalesce(*[filled(c) for c in ("doi", "arxiv_id", "semantic_scholar_id", "openalex_id")], F.col("title"))


def looks_like_identifier(x: Column | str) -> Column:
    t = F.trim(col(x))
    return (t != "") & ~t.rlike(r"\s")


def sorted_tokens(x: Column | str) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(col(x)), r"\s+"), lambda w: w != "")), " ")


def safe_int(x: Column | str) -> Column:
    return col(x).try_cast("int")


def quoted_names(x: Column | str) -> Column:
    return F.regexp_extract_all(col(x), F.lit("'([^']+)'"), F.lit(1))


def truncated(x: Column | str, n: int) -> Column:
    t = F.trim(F.coalesce(col(x), F.lit("")))
    return F.when(F.char_length(t) <= n, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(n - 1))), F.lit("…")))


def author_line(names: Column | str, most: int = 3, ending: str = " et al.", none: str = "") -> Column:
    """The first names, then ``ending`` if there are more; ``none`` if there is no name. Lists show 3 (", et al.", "—"), cards 5, graphs 3."""
    names = col(names)
    shown = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(shown, F.lit(ending))).when(F.size(names) > 0, shown).otherwise(F.lit(none))


# --- queries ----------------------------------------------------------------------------------------------------------


def has_boolean_operators(raw: Column | str) -> Column:
    return F.arrays_overlap(F.split(col(raw), r"\s+"), F.lit(OPERATORS))


def strip_boolean(raw: Column | str) -> Column:
    """Quoted phrases and words without AND, OR, NOT and brackets."""
    tokens = F.regexp_extract_all(col(raw), F.lit(r'("[^"]*"|[^\s()"]+)'), F.lit(1))
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(OPERATORS)), " ")


def strictness(n: Column) -> Column:
    """Share of keywords that must match."""
    return F.when(n <= 3, 0.8).when(n <= 6, 0.5).otherwise(F.least(F.lit(0.3), 3 / n))


def quoted(keyword: Column) -> Column:
    return F.when(F.contains(keyword, F.lit(" ")), F.concat(F.lit('"'), keyword, F.lit('"'))).otherwise(keyword)


def build_query(keywords: Column | str, source: Column | str, domain: Column | None = None, share: Column | None = None) -> Column:
    """The first max(1, round(n * share)) keywords all have to match, of the rest any; halves round to even."""
    kws, source = col(keywords), col(source)
    n = F.size(kws)
    must_n = F.greatest(F.lit(1), F.bround(n * (strictness(n) if share is None else share)).cast("int"))
    wrapped = F.transform(kws, quoted)
    word = source.isin(AND_WORD)
    must, rest = F.slice(wrapped, F.lit(1), must_n), F.slice(wrapped, must_n + 1, F.greatest(n - must_n, F.lit(0)))
    must = F.when(word, F.array_join(must, " AND ")).otherwise(F.array_join(must, " "))
    rest = F.when(source.isin(SPACE_FOR_OR), F.array_join(rest, " ")).otherwise(F.array_join(rest, " OR "))
    query = F.when(n <= must_n, must).when(word, F.concat(F.lit("("), must, F.lit(") AND ("), rest, F.lit(")"))).otherwise(F.concat(must, F.lit(" "), rest))
    if domain is not None:
        with_domain = F.when(word, F.concat(F.lit("("), query, F.lit(") AND "), quoted(domain))).otherwise(F.concat(query, F.lit(" "), quoted(domain)))
        query = F.when(filled(domain).isNull(), query).otherwise(with_domain)
    return F.when(n == 0, "").otherwise(F.trim(query))


def source_query(raw: Column | str, source: Column | str) -> Column:
    """A query as one source takes it: without operators where it knows none."""
    return F.when(col(source).isin(NO_BOOLEAN) & has_boolean_operators(raw), strip_boolean(raw)).otherwise(col(raw))


def parsed_keywords(raw: Column | str) -> Column:
    """Keywords of a search line, each once in any case: quoted phrases, then words of two characters or more without operators and brackets. -word and -"phrase" go."""
    kept = F.regexp_replace(F.regexp_replace(col(raw), '-"[^"]*"', ""), r"-\S+", "")
    phrases = F.filter(F.transform(F.regexp_extract_all(kept, F.lit('"([^"]+)"'), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    words = F.split(F.regexp_replace(F.regexp_replace(kept, '"[^"]*"', ""), "[()]", " "), r"\s+")
    words = F.filter(words, lambda x: (F.char_length(x) >= 2) & ~x.isin(OPERATORS) & ~x.isin([x.lower() for x in OPERATORS]))
    every = F.concat(phrases, words)
    lower = F.transform(every, lambda y: F.lower(y))
    return F.filter(every, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def keywords_to_query(keywords: Column | str) -> Column:
    """Joined by AND; several words are quoted unless they are quoted or grouped already."""
    kws = F.filter(F.transform(col(keywords), lambda x: F.trim(x)), lambda x: x != "")
    done = lambda x: x.startswith("(") | x.startswith('"') | ~F.contains(x, F.lit(" "))
    return F.array_join(F.transform(kws, lambda x: F.when(done(x), x).otherwise(F.concat(F.lit('"'), x, F.lit('"')))), " AND ")


def matches_all(keywords: list[str], title: Column | str = "title", abstract: Column | str = "abstract") -> Column:
    """Every keyword occurs, in any case, in title or abstract."""
    hit = F.lit(True)
    for k in keywords:
        part = lambda c: F.coalesce(F.contains(F.lower(col(c)), F.lit(k.lower())), F.lit(False))
        hit = hit & (part(title) | part(abstract))
    return hit


def matches_any(keywords: list[str], title: Column | str = "title", abstract: Column | str = "abstract") -> Column:
    """Any keyword that is not blank occurs in title and abstract put together; no keywords match all."""
    if not keywords:
        return F.lit(True)
    both = F.lower(F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "), F.coalesce(col(abstract), F.lit(""))))
    hit = F.lit(False)
    for k in keywords:
        if k.strip():
            hit = hit | F.contains(both, F.lit(k.strip().lower()))
    return hit


def candidate_phrases(text: Column | str) -> Column:
    """Runs of words between stopwords and words of one character."""
    tokens = F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9-]+"), F.lit(0))
    marked = F.transform(tokens, lambda t: F.when(t.isin(STOPWORDS) | (F.char_length(t) < 2), F.lit("|")).otherwise(t))
    runs = F.split(F.array_join(marked, " "), r"\|")
    return F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: r != "")


# --- code and data ----------------------------------------------------------------------------------------------------


def repo_url(code_url: Column | str, abstract: Column | str) -> Column:
    """The repository's address from code_url, else from the abstract; GitHub before GitLab, without one file ending, then without dots at the end."""

    def found(x: Column) -> Column:
        def address(pattern: str, host: str) -> Column:
            path = filled(F.regexp_extract(x, pattern, 1))
            return F.concat(F.lit(f"https://{host}/"), F.regexp_replace(F.regexp_replace(path, r"\.(?:git|zip|tar\.gz)$", ""), r"\.+$", ""))

        return F.coalesce(address(GITHUB, "github.com"), address(GITLAB, "gitlab.com"))

    return F.coalesce(found(col(code_url)), found(col(abstract)))


def has_dataset(abstract: Column | str) -> Column:
    return F.coalesce(col(abstract).rlike(DATASET), F.lit(False))


# --- BibTeX -----------------------------------------------------------------------------------------------------------


def cite_key(authors: Column | str, year: Column | str, title: Column | str) -> Column:
    """Last name of the first author, year and first word of the title, letters and digits only."""
    alnum = lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    last = F.try_element_at(F.split(F.trim(F.get(col(authors), F.lit(0))["name"]), r"\s+"), F.lit(-1))
    first = F.when(filled(F.trim(col(title))).isNotNull(), F.get(F.split(F.trim(col(title)), r"\s+"), F.lit(0)))
    year = F.when(col(year) != 0, col(year).cast("string"))
    return F.concat(alnum(F.coalesce(last, F.lit("unknown"))), F.coalesce(year, F.lit("0000")), alnum(F.coalesce(first, F.lit("untitled"))))


def entry_type() -> Column:
    arxiv, journal, venue = (filled(c).isNotNull() for c in ("arxiv_id", "journal", "venue"))
    return F.when(arxiv & ~journal & ~venue, "misc").when(journal, "article").when(venue, "inproceedings").otherwise("misc")


def bibtex() -> Column:
    """A BibTeX entry of a paper row; a native one stays."""
    kind, arxiv = entry_type(), filled("arxiv_id")

    def field(name: str, value: Column) -> Column:
        safe = F.replace(F.replace(filled(value), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
        return F.concat(F.lit(f"  {name:<14} = {{"), safe, F.lit("}"))

    names = F.when(F.size("authors") > 0, F.array_join(F.transform("authors", lambda a: a["name"]), " and ")).otherwise("Unknown")
    fields = F.concat_ws(
        "\n", field("title", F.col("title")), field("author", names), field("year", F.when(F.col("year") != 0, F.col("year").cast("string"))),
        F.when(kind == "article", field("journal", F.col("journal"))), F.when(kind == "inproceedings", field("booktitle", F.col("venue"))),
        field("volume", F.col("volume")), field("number", F.col("issue")), field("pages", F.col("pages")), field("publisher", F.col("publisher")),
        field("doi", F.col("doi")), field("url", F.coalesce(filled("pdf_url"), filled("landing_url"))), field("eprint", arxiv),
        F.when(arxiv.isNotNull(), field("archivePrefix", F.lit("arXiv"))), F.when(arxiv.isNotNull(), field("primaryClass", F.get("fields_of_study", F.lit(0)))),
        F.when(arxiv.isNotNull() & (kind == "misc"), field("note", F.concat(F.lit("arXiv:"), arxiv))),
    )
    made = F.concat(F.lit("@"), kind, F.lit("{"), cite_key("authors", "year", "title"), F.lit(",\n"), fields, F.lit("\n}"))
    return F.coalesce(filled("bibtex"), made)


def bib_context(entries: Column | str, most: int = 20) -> Column:
    """One line an entry that has a title or keywords: title, keywords, 300 characters of abstract."""

    def line(e: Column) -> Column:
        words = F.when(F.size(e["keywords"]) > 0, F.concat(F.lit("Keywords: "), F.array_join(e["keywords"], ", ")))
        return F.concat_ws(" | ", F.concat(F.lit("Title: "), filled(e["title"])), words, F.concat(F.lit("Abstract: "), F.left(filled(e["abstract"]), F.lit(300))))

    told = F.filter(F.slice(col(entries), 1, most), lambda e: filled(e["title"]).isNotNull() | (F.size(e["keywords"]) > 0))
    return F.array_join(F.transform(told, line), "\n")


# --- display ----------------------------------------------------------------------------------------------------------


def relative_time(at: Column | str, now: Column) -> Column:
    """How long ago, each unit rounded (halves up) from the one below."""
    nearest = lambda x, size: F.floor(x / size + 0.5)
    sec = nearest(F.timestamp_diff("MILLISECOND", col(at), now), 1000)
    minutes = nearest(sec, 60)
    hours = nearest(minutes, 60)
    days = nearest(hours, 24)
    months = nearest(days, 30)
    of = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (F.when(sec < 45, "just now").when(minutes < 60, of(minutes, "m")).when(hours < 24, of(hours, "h")).when(days < 30, of(days, "d"))
            .when(months < 12, of(months, "mo")).otherwise(of(nearest(months, 12), "y")))


def compact(n: Column | str) -> Column:
    """1.2k from a thousand on."""
    return F.when(col(n) >= 1000, F.format_string("%.1fk", col(n).cast("double") / 1000)).otherwise(col(n).cast("string"))


def score_bucket(share: Column) -> Column:
    return F.when(share >= 0.7, "high").when(share >= 0.4, "medium").otherwise("low")


# The messages.
def describe_error(status: Column | str, kind: Column | str, message: Column | str) -> Column:
    """What went wrong with a source, from HTTP status, kind of error and message (cut at 80 characters)."""
    s, m = col(status), col(message)
    return (
        F.when(col(kind) == "timeout", "Request timed out").when(s == 429, "Rate limited — too many requests").when(s.isin(401, 403), "Missing or invalid API key")
        .when(s == 400, "Bad request — query may be malformed").when(s >= 500, F.format_string("Server error (HTTP %d)", s)).when(s.isNotNull(), F.format_string("HTTP %d", s))
        .when(col(kind) == "connect", "Could not connect to API").when(col(kind) == "read_timeout", "API response timed out")
        .when(F.char_length(m) > 80, F.concat(F.left(m, F.lit(77)), F.lit("..."))).otherwise(F.coalesce(filled(m), F.lit("Unknown error")))
    )


def sources_label(queried: Column | str, failed: Column | str) -> Column:
    """Queried sources that did not fail, joined; the first underscore of each is a space."""
    return F.array_join(F.transform(F.array_except(col(queried), col(failed)), lambda s: F.regexp_replace(s, "^([^_]*)_", "$1 ")), ", ")


def failed_label(failed: Column | str, reasons: Column | str) -> Column:
    """Failed sources with the reason from a map, if any, in brackets."""
    name = lambda s: F.regexp_replace(s, "^([^_]*)_", "$1 ")
    told = lambda s: F.concat(name(s), F.coalesce(F.concat(F.lit(" ("), filled(F.try_element_at(col(reasons), s)), F.lit(")")), F.lit("")))
    return F.array_join(F.transform(col(failed), told), ", ")


def cluster_color(community: Column | str, palette: list[str]) -> Column:
    return F.element_at(F.lit(palette), (F.pmod(col(community), F.lit(len(palette))) + 1).cast("int"))


def blend(a: Column, b: Column, share: float) -> Column:
    """Channelwise mix of two #rrggbb colours, ``share`` of the second."""

    def channel(k: int) -> Column:
        of = lambda c: F.conv(F.substring(c, 2 + 2 * k, 2), 16, 10).cast("double")
        return F.lpad(F.lower(F.hex(F.round(of(a) * (1 - share) + of(b) * share).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(1), channel(2))
