"""Records of the eight sources, landed as JSON lines or XML, brought to the paper schema.

Each ``Source`` has the schema of its landed records (only fields that are used, so parsers skip the rest) and
a projection. Readers are plain DataFrameReader scans: splittable JSON lines, or XML by row tag.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.functions.text import filled
from quillspark.schemas import AUTHOR, PAPER

#: Flags that are never null.
PLAIN_FALSE = ("is_open_access", "has_dataset")


def as_papers(rows: DataFrame, source: str, **cols: Column) -> DataFrame:
    """The given columns in the paper schema; other lists are empty, flags false, everything else null. Rows without a title stay, as ''."""
    cols = {"title": F.lit(""), "sources": F.array(F.lit(source)), **cols}
    out = []
    for f in PAPER:
        t = f.dataType
        if f.name == "ord":
            value = F.col("ord") if "ord" in rows.columns else F.monotonically_increasing_id()
        elif f.name in cols:
            value = cols[f.name]
            value = F.coalesce(value, F.lit("")) if f.name == "title" else value
        elif f.name in PLAIN_FALSE:
            value = F.lit(False)
        elif f.name == "repo_stars":
            value = F.lit(0)
        elif t.typeName() == "array" and f.name != "versions":
            value = F.array()
        else:
            value = F.lit(None)
        value = value.cast(t)
        if f.name in PLAIN_FALSE:
            value = F.coalesce(value, F.lit(False))
        elif t.typeName() == "array" and f.name != "versions":
            value = F.coalesce(value, F.array().cast(t))
        out.append(value.alias(f.name))
    return rows.select(*out)


def author(name: Column, **known: Column) -> Column:
    fields = {"name": name, "openalex_id": F.lit(None), "semantic_scholar_id": F.lit(None), "orcid": F.lit(None), "affiliations": F.array()} | known
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(AUTHOR)


def each(array: Column, of: Callable[[Column], Column]) -> Column:
    return F.transform(F.coalesce(array, F.array()), of)


def full(array: Column) -> Column:
    """Without null and empty members; null if the list is."""
    return F.filter(array, lambda x: F.coalesce(x, F.lit("")) != "")


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def digits_year(x: Column) -> Column:
    return F.when(x.cast("string").rlike("^[0-9]+$"), x.cast("string").try_cast("int"))


def abstract_from_index(index: Column) -> Column:
    """Text of an inverted index (word to positions): words in order of position, of several at one position the last."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    by_place = F.array_sort(F.transform(placed, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w"))))
    words = F.map_from_entries(F.transform(by_place, lambda x: F.struct(x["p"], x["w"])))
    return filled(F.array_join(F.map_values(words), " "))


def openalex(r: DataFrame) -> DataFrame:
    c, where = F.col, F.col("primary_location")
    first_page, last_page = filled(c("biblio.first_page")), filled(c("biblio.last_page"))
    people = each(c("authorships"), lambda a: author(
        F.coalesce(a["author"]["display_name"], F.lit("")), openalex_id=a["author"]["id"], orcid=a["author"]["orcid"], affiliations=full(each(a["institutions"], lambda i: i["display_name"]))))
    names = lambda x: each(x, lambda v: F.coalesce(v["display_name"], F.lit("")))
    return as_papers(
        r, "openalex", doi=filled(F.replace(c("doi"), F.lit("https://doi.org/"), F.lit(""))), openalex_id=c("id"),
        arxiv_id=filled(F.replace(c("ids.arxiv"), F.lit("https://arxiv.org/abs/"), F.lit(""))), title=c("title"), abstract=abstract_from_index(c("abstract_inverted_index")),
        year=c("publication_year"), publication_date=c("publication_date"), authors=people, journal=where["source"]["display_name"], venue=where["source"]["display_name"],
        volume=c("biblio.volume"), issue=c("biblio.issue"), pages=F.coalesce(F.concat(first_page, F.lit("-"), last_page), c("biblio.first_page")),
        is_open_access=c("open_access.is_oa"), pdf_url=c("open_access.oa_url"), landing_url=where["landing_page_url"], citation_count=c("cited_by_count"),
        references=each(c("referenced_works"), lambda x: F.replace(x, F.lit("https://openalex.org/"), F.lit(""))), fields_of_study=names(c("concepts")), keywords=names(c("keywords")),
    )


def semantic_scholar(r: DataFrame) -> DataFrame:
    c = F.col
    return as_papers(
        r, "semantic_scholar", doi=c("externalIds.DOI"), arxiv_id=c("externalIds.ArXiv"), semantic_scholar_id=c("paperId"), pubmed_id=c("externalIds.PubMed"), title=c("title"),
        abstract=c("abstract"), year=c("year"), publication_date=c("publicationDate"), journal=c("journal.name"), venue=c("journal.name"), volume=c("journal.volume"), pages=c("journal.pages"),
        authors=each(c("authors"), lambda a: author(F.coalesce(a["name"], F.lit("")), semantic_scholar_id=a["authorId"])), is_open_access=c("isOpenAccess"), pdf_url=c("openAccessPdf.url"),
        citation_count=c("citationCount"), reference_count=c("referenceCount"), fields_of_study=c("fieldsOfStudy"),
        is_peer_reviewed=F.coalesce(F.arrays_overlap(c("publicationTypes"), F.lit(["JournalArticle", "Conference"])), F.lit(False)),
    )


def arxiv(r: DataFrame) -> DataFrame:
    c = F.col
    line = lambda x: F.replace(F.trim(x), F.lit("\n"), F.lit(" "))
    full_id = F.trim(F.coalesce(c("id"), F.lit("")))
    named = F.element_at(F.split(full_id, "/abs/"), -1)
    base = filled(F.regexp_replace(named, r"v\d+$", ""))
    pdf = first(F.filter(each(c("link"), lambda x: F.struct(x["_title"].alias("t"), x["_href"].alias("h"))), lambda x: x["t"] == "pdf"))["h"]
    return as_papers(
        r.where(line(c("title")) != ""), "arxiv", doi=F.trim(c("doi")), arxiv_id=F.coalesce(base, F.lit("")), title=line(c("title")), abstract=line(c("summary")), publication_date=F.trim(c("published")),
        year=F.left(F.trim(c("published")), F.lit(4)).try_cast("int"), authors=each(F.filter(c("author"), lambda a: filled(a["name"]).isNotNull()), lambda a: author(F.trim(a["name"]))),
        journal=F.trim(c("journal_ref")), fields_of_study=full(each(c("category"), lambda x: x["_term"])), is_open_access=F.lit(True),
        pdf_url=F.coalesce(filled(pdf), F.concat(F.lit("https://arxiv.org/pdf/"), base)), landing_url=F.concat(F.lit("https://arxiv.org/abs/"), base),
    )


def europe_pmc(r: DataFrame) -> DataFrame:
    c = F.col
    people = full(each(F.split(F.regexp_replace(F.coalesce(c("authorString"), F.lit("")), r"\.+$", ""), ","), lambda x: F.trim(x)))
    return as_papers(
        r, "europe_pmc", doi=c("doi"), pubmed_id=c("pmid"), title=c("title"), abstract=c("abstractText"), year=digits_year(c("pubYear")), publication_date=c("firstPublicationDate"),
        authors=each(people, lambda n: author(n)), journal=c("journalTitle"), venue=c("journalTitle"), is_open_access=c("isOpenAccess") == "Y",
        pdf_url=first(F.filter(c("fullTextUrlList.fullTextUrl"), lambda u: u["documentStyle"] == "pdf"))["url"], citation_count=c("citedByCount"),
        mesh_terms=full(each(c("meshHeadingList.meshHeading"), lambda m: m["meshHeading"])), keywords=c("keywordList.keyword"),
        is_peer_reviewed=F.lower(F.coalesce(c("pubType"), F.lit(""))) == "journal article",
    )


def dblp(r: DataFrame) -> DataFrame:
    """``authors.author`` is a list or a single member, of objects with text or of strings; it is read as JSON text."""
    c, i = F.col, F.col("info")
    raw = F.coalesce(i["authors"]["author"], F.lit("[]"))
    listed = F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), F.when(raw.startswith("{"), raw).otherwise(F.to_json(F.array(raw)).substr(F.lit(2), F.char_length(F.to_json(F.array(raw))) - 2)), F.lit("]")))
    people = each(F.from_json(listed, "array<string>"), lambda a: author(F.coalesce(F.when(a.startswith("{"), F.get_json_object(a, "$.text")), a)))
    kind = F.coalesce(i["type"], F.lit(""))
    return as_papers(
        r, "dblp", doi=filled(F.replace(i["doi"], F.lit("https://doi.org/"), F.lit(""))), dblp_key=i["key"], title=i["title"], year=digits_year(i["year"]), authors=people,
        journal=F.when(F.contains(F.lower(kind), F.lit("journal")), i["venue"]), venue=i["venue"], is_peer_reviewed=kind.isin("Journal Articles", "Conference and Workshop Papers"), landing_url=i["url"],
    )


def crossref(r: DataFrame) -> DataFrame:
    c = F.col
    given = lambda a: F.concat_ws(" ", filled(a["given"]), filled(a["family"]))
    people = F.filter(
        each(c("author"), lambda a: author(F.coalesce(filled(given(a)), a["name"]), orcid=filled(F.replace(a["ORCID"], F.lit("http://orcid.org/"), F.lit(""))), affiliations=full(each(a["affiliation"], lambda x: x["name"])))),
        lambda a: F.coalesce(a["name"], F.lit("")) != "")
    dates = F.coalesce(c("published.date-parts"), c("published-print.date-parts"))
    return as_papers(
        r, "crossref", doi=filled(F.trim(c("DOI"))), title=first(c("title")), abstract=c("abstract"), year=first(first(dates)), authors=people, journal=first(c("container-title")), venue=first(c("container-title")),
        volume=c("volume"), issue=c("issue"), pages=c("page"), publisher=c("publisher"), issn=first(c("ISSN")), isbn=first(c("ISBN")), citation_count=c("is-referenced-by-count"),
        reference_count=c("reference-count"), is_peer_reviewed=F.coalesce(c("type"), F.lit("")).isin("journal-article", "proceedings-article", "book-chapter"),
        pdf_url=first(F.filter(c("link"), lambda x: x["content-type"] == "application/pdf"))["URL"], keywords=c("subject"),
    )


def core(r: DataFrame) -> DataFrame:
    c = F.col
    journal = first(c("journals"))["title"]
    return as_papers(
        r, "core", doi=c("doi"), core_id=filled(c("id")), title=c("title"), abstract=c("abstract"), year=F.nullif(c("yearPublished").try_cast("int"), F.lit(0)),
        authors=each(F.filter(c("authors"), lambda a: filled(a["name"]).isNotNull()), lambda a: author(a["name"])), journal=journal, venue=journal, is_open_access=F.lit(True),
        pdf_url=F.coalesce(filled(c("downloadUrl")), first(c("sourceFulltextUrls"))), keywords=c("topics"),
    )


def pubmed(r: DataFrame) -> DataFrame:
    a, m = F.col("MedlineCitation.Article"), F.col("MedlineCitation")
    issue = a["Journal"]["JournalIssue"]
    name = lambda x: filled(F.trim(F.concat_ws(" ", filled(F.trim(x["ForeName"])), filled(F.trim(x["LastName"])))))
    people = each(a["AuthorList"]["Author"], lambda x: author(F.coalesce(name(x), F.trim(x["CollectiveName"])), affiliations=full(each(x["AffiliationInfo"], lambda y: F.trim(y["Affiliation"])))))
    dois = F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda x: (x["_IdType"] == "doi") & filled(x["_VALUE"]).isNotNull())
    year = digits_year(F.trim(issue["PubDate"]["Year"]))
    return as_papers(
        r, "pubmed", doi=F.trim(F.try_element_at(dois, F.lit(-1))["_VALUE"]), pubmed_id=F.trim(m["PMID"]["_VALUE"]), title=F.trim(a["ArticleTitle"]),
        abstract=filled(F.array_join(full(each(a["Abstract"]["AbstractText"], lambda x: F.trim(x["_VALUE"]))), " ")), year=year,
        authors=F.filter(people, lambda x: F.coalesce(x["name"], F.lit("")) != ""), journal=F.trim(a["Journal"]["Title"]), venue=F.trim(a["Journal"]["Title"]), volume=F.trim(issue["Volume"]),
        issue=F.trim(issue["Issue"]), pages=F.trim(a["Pagination"]["MedlinePgn"]), mesh_terms=full(each(m["MeshHeadingList"]["MeshHeading"], lambda x: x["DescriptorName"]["_VALUE"])),
        keywords=full(each(m["KeywordList"]["Keyword"], lambda x: F.trim(x["_VALUE"]))), is_peer_reviewed=F.lit(True),
    )


@dataclass(frozen=True)
class Source:
    schema: str
    normalize: Callable[[DataFrame], DataFrame]
    row_tag: str | None = None
    #: Fields of the landed record without which the source cannot answer.
    needs_key: bool = False


NAMED = "array<struct<display_name:string>>"
VALUE = "struct<_VALUE:string>"
SOURCES: dict[str, Source] = {
    "openalex": Source(
        "id string, doi string, title string, publication_year int, publication_date string, ids struct<arxiv:string>, abstract_inverted_index map<string,array<int>>,"
        f" authorships array<struct<author:struct<display_name:string,id:string,orcid:string>,institutions:{NAMED}>>, primary_location struct<source:struct<display_name:string>,landing_page_url:string>,"
        f" biblio struct<first_page:string,last_page:string,volume:string,issue:string>, open_access struct<is_oa:boolean,oa_url:string>, cited_by_count bigint, referenced_works array<string>, concepts {NAMED}, keywords {NAMED}",
        openalex),
    "semantic_scholar": Source(
        "paperId string, externalIds struct<DOI:string,ArXiv:string,PubMed:string>, title string, abstract string, year int, publicationDate string, journal struct<name:string,volume:string,pages:string>,"
        " authors array<struct<name:string,authorId:string>>, isOpenAccess boolean, openAccessPdf struct<url:string>, citationCount bigint, referenceCount bigint, fieldsOfStudy array<string>, publicationTypes array<string>",
        semantic_scholar),
    "arxiv": Source(
        "id string, title string, summary string, published string, doi string, journal_ref string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_title:string,_href:string>>",
        arxiv, "entry"),
    "europe_pmc": Source(
        "doi string, pmid string, title string, abstractText string, pubYear string, firstPublicationDate string, authorString string, journalTitle string, isOpenAccess string, citedByCount bigint, pubType string,"
        " fullTextUrlList struct<fullTextUrl:array<struct<url:string,documentStyle:string>>>, meshHeadingList struct<meshHeading:array<struct<meshHeading:string>>>, keywordList struct<keyword:array<string>>",
        europe_pmc),
    "dblp": Source("info struct<authors:struct<author:string>,doi:string,type:string,year:string,key:string,venue:string,title:string,url:string>", dblp),
    "crossref": Source(
        "DOI string, title array<string>, abstract string, author array<struct<given:string,family:string,name:string,ORCID:string,affiliation:array<struct<name:string>>>>, published struct<`date-parts`:array<array<int>>>,"
        " `published-print` struct<`date-parts`:array<array<int>>>, `container-title` array<string>, volume string, issue string, page string, publisher string, ISSN array<string>, ISBN array<string>,"
        " `is-referenced-by-count` bigint, `reference-count` bigint, type string, link array<struct<URL:string,`content-type`:string>>, subject array<string>",
        crossref),
    "core": Source(
        "id string, doi string, title string, abstract string, yearPublished string, authors array<struct<name:string>>, journals array<struct<title:string>>, downloadUrl string, sourceFulltextUrls array<string>, topics array<string>",
        core, needs_key=True),
    "pubmed": Source(
        f"MedlineCitation struct<PMID:{VALUE},Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<{VALUE}>>,"
        "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,CollectiveName:string,AffiliationInfo:array<struct<Affiliation:string>>>>>,"
        "Journal:struct<Title:string,JournalIssue:struct<Volume:string,Issue:string,PubDate:struct<Year:string>>>,Pagination:struct<MedlinePgn:string>>,"
        f"MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:{VALUE}>>>,KeywordList:struct<Keyword:array<{VALUE}>>>,"
        "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>",
        pubmed, "PubmedArticle"),
}


def from_landed(rows: DataFrame, name: str, raw: str) -> DataFrame:
    """Papers out of a column of JSON or XML text, for records that arrive in a table; ``ord`` is kept."""
    source = SOURCES[name]
    record = F.from_xml(F.col(raw), source.schema, {"rowTag": source.row_tag, "ignoreNamespace": "true"}) if source.row_tag else F.from_json(F.col(raw), source.schema)
    held = rows.select("ord", record.alias("r"))
    return source.normalize(held.select("ord", "r.*"))


def chosen(names: list[str] | None) -> dict[str, Source]:
    """Sources by name; unknown names are dropped, none means all."""
    return {k: v for k, v in SOURCES.items() if not names or k in names}


def read_source(spark: SparkSession, name: str, path: str, limit: int | None = None, has_key: bool = True) -> DataFrame:
    """Landed records of one source as papers. A source that needs a key gives no rows without one. ``limit`` is pushed below the projection."""
    source = SOURCES[name]
    reader = spark.read.schema(source.schema)
    rows = reader.format("xml").option("rowTag", source.row_tag).option("ignoreNamespace", True).load(path) if source.row_tag else reader.json(path)
    if source.needs_key and not has_key:
        rows = rows.where(F.lit(False))
    return source.normalize(rows.limit(limit) if limit else rows)


def federated(spark: SparkSession, paths: dict[str, str], names: list[str] | None = None, per_source: int | None = 10_000) -> DataFrame:
    """Papers of several sources, each cut before the union; ``ord`` numbers them by source, then by place."""
    out = None
    for rank, name in enumerate(chosen(names)):
        if name in paths:
            rows = read_source(spark, name, paths[name], per_source)
            rows = rows.withColumn("ord", F.col("ord") + F.lit(rank << 48))
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], PAPER)
