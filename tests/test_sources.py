"""Landed records of the sources, BibTeX, the corpus and its citations."""

import json

import pytest

from quillspark.operators import traverse
from quillspark.sources import bibtex, files, normalize

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A
 title</title><summary> Text </summary><published>2021-01-02T00:00:00Z</published><author><name>Ada L</name></author><author><name>Bo M</name></author>
<category term="cs.LG"/><link title="pdf" href="http://x/p.pdf"/><link href="http://x/a"/></entry><entry><id>x</id><title></title></entry></feed>"""
PUBMED = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">77</PMID><Article><ArticleTitle>On cells</ArticleTitle>
<Abstract><AbstractText Label="A">One.</AbstractText><AbstractText Label="B">Two.</AbstractText></Abstract>
<AuthorList><Author ValidYN="Y"><LastName>Doe</LastName><ForeName>J</ForeName><AffiliationInfo><Affiliation>Lab</Affiliation></AffiliationInfo></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList>
<Journal><Title>J</Title><JournalIssue><Volume>3</Volume><PubDate><Year>1999</Year></PubDate></JournalIssue></Journal></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1">Cells</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"""


def land(tmp_path, name, *records):
    (p := tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    return str(p)


def test_arxiv(spark, tmp_path):
    (p := tmp_path / "a.xml").write_text(ATOM)
    (r,) = normalize.read_source(spark, "arxiv", str(p)).collect()
    assert (r.arxiv_id, r.title, r.year, [a.name for a in r.authors]) == ("2101.00001", "A  title", 2021, ["Ada L", "Bo M"])
    assert r.pdf_url == "http://x/p.pdf" and r.is_open_access and r.fields_of_study == ["cs.LG"]


def test_pubmed(spark, tmp_path):
    (p := tmp_path / "p.xml").write_text(PUBMED)
    (r,) = normalize.read_source(spark, "pubmed", str(p)).collect()
    assert (r.pubmed_id, r.abstract, r.year, r.doi) == ("77", "One. Two.", 1999, "10.1/x")
    assert [a.name for a in r.authors] == ["J Doe", "Group"] and r.authors[0].affiliations == ["Lab"] and r.mesh_terms == ["Cells"]


def test_openalex(spark, tmp_path):
    w = {"id": "W1", "doi": "https://doi.org/10.1/A", "title": "T", "abstract_inverted_index": {"b": [1, 3], "a": [0], "c": [2]}, "biblio": {"first_page": "1", "last_page": "9"}, "referenced_works": ["https://openalex.org/W2"],
         "authorships": [{"author": {"display_name": "X"}, "institutions": [{"display_name": "U"}, {}]}], "concepts": [{"display_name": "C"}]}
    (r,) = normalize.read_source(spark, "openalex", land(tmp_path, "o", w)).collect()
    assert (r.doi, r.abstract, r.pages, r.references, r.fields_of_study, r.is_open_access) == ("10.1/A", "a b c b", "1-9", ["W2"], ["C"], False)
    assert r.authors[0].affiliations == ["U"]


def test_semantic_scholar_crossref_core(spark, tmp_path):
    (r,) = normalize.read_source(spark, "semantic_scholar", land(tmp_path, "s", {"paperId": "p", "externalIds": {"DOI": "d"}, "publicationTypes": ["Review", "Conference"]})).collect()
    assert (r.semantic_scholar_id, r.doi, r.title, r.is_peer_reviewed) == ("p", "d", "", True)
    item = {"DOI": " 10/x ", "title": ["T", "U"], "published": {"date-parts": [[2001, 2]]}, "author": [{"given": "A", "family": "B", "ORCID": "http://orcid.org/1"}, {"name": "Org"}, {}], "type": "book-chapter", "link": [{"URL": "u", "content-type": "text/html"}, {"URL": "v", "content-type": "application/pdf"}]}
    (r,) = normalize.read_source(spark, "crossref", land(tmp_path, "c", item)).collect()
    assert (r.doi, r.title, r.year, [a.name for a in r.authors], r.authors[0].orcid, r.pdf_url, r.is_peer_reviewed) == ("10/x", "T", 2001, ["A B", "Org"], "1", "v", True)
    path = land(tmp_path, "k", {"id": 5, "title": "T", "yearPublished": "2003", "sourceFulltextUrls": ["f"], "authors": [{"name": "N"}, {"name": ""}]})
    (r,) = normalize.read_source(spark, "core", path).collect()
    assert (r.core_id, r.year, r.pdf_url, len(r.authors), r.is_open_access) == ("5", 2003, "f", 1, True)
    assert normalize.read_source(spark, "core", path, has_key=False).count() == 0


def test_dblp_author_shapes(spark, tmp_path):
    of = lambda a: {"info": {"authors": {"author": a}, "type": "Journal Articles", "venue": "V", "year": "2000", "title": "T"}}
    path = land(tmp_path, "d", of([{"text": "A"}, {"text": "B"}]), of({"text": "C"}), of("D"), {"info": {"title": "none"}})
    rows = normalize.read_source(spark, "dblp", path).orderBy("ord").collect()
    assert [[a.name for a in r.authors] for r in rows] == [["A", "B"], ["C"], ["D"], []]
    assert rows[0].journal == "V" and rows[0].is_peer_reviewed and not rows[3].is_peer_reviewed


def test_federated_and_registry(spark, tmp_path):
    paths = {"core": land(tmp_path, "k2", {"id": 1}, {"id": 2}), "dblp": land(tmp_path, "d2", {"info": {"title": "T"}})}
    assert normalize.federated(spark, paths, per_source=1).count() == 2
    assert normalize.federated(spark, paths, ["dblp", "unknown"]).count() == 1 and normalize.federated(spark, {}).count() == 0


def test_bibtex(spark):
    text = '@article{k1,\n title = {A {Deep} Title},\n author="X and Y", year = 2020,\n keywords = {nets; Graphs, nets}}\n@misc{broken, title = '
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    rows = bibtex.parse_bibtex(df).orderBy("ord").collect()
    assert (rows[0].entry_type, rows[0].title, rows[0].year, rows[0].keywords) == ("article", "A Deep Title", "2020", ["nets", "Graphs", "nets"])
    assert [r.entry_type for r in rows] == ["article", "misc"] and bibtex.bib_keywords(bibtex.parse_bibtex(df)).first().keywords == ["nets", "Graphs"]


@pytest.mark.parametrize(("text", "want"), [
    ("", []), ("no entry @ here {", []), ("@a{k, x = {1}, x = {2}}", [("a", {"x": "2"})]), ('@A {k, t = "say {"}hi{"} now", y=2020}', [("a", {"t": 'say "hi" now', "y": "2020"})]),
    ("@a{k, t = {never closed @b{j, u = {v}}", [("a", {"t": "never closed"}), ("b", {"u": "v"})]), ("@a{k, n = bare value\n, m = 3 }", [("a", {"n": "bare value", "m": "3"})]),
])
def test_bibtex_entries(text, want):
    assert bibtex.entries(text) == want


def test_corpus(spark, tmp_path):
    a, b = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"
    (p := tmp_path / "c.csv").write_text(f"id,title,abstract,authors,venue,year,n_citation,references,predicted_main_archetype,predicted_second_tier_archetype\n{a},One,,\"['Ann B', 'C D']\",V,0,x,\"['{b}', '{a}']\",None,\n{b},One,t,[],,2001,7,[],The Analyst,\n")
    rows = files.read_corpus(spark, str(p))
    one, two = files.corpus_papers(rows).orderBy("ord").collect()
    assert (one.year, one.citation_count, one.reference_count, one.abstract, one.predicted_main_archetype, [x.name for x in one.authors]) == (None, None, 2, None, None, ["Ann B", "C D"])
    assert (two.year, two.citation_count, two.reference_count, two.predicted_main_archetype) == (2001, 7, None, "The Analyst")
    files.write_index(rows, str(tmp_path / "i"))
    index = files.read_index(spark, str(tmp_path / "i"))
    assert sorted((r.src, r.dst) for r in index["cites_by_src"].collect()) == [(a, a), (a, b)]
    assert index["titles"].first().id == a
    assert traverse.reference_counts(index["cites_by_dst"]).first().reference_count == 2
