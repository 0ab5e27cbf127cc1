"""Identities and duplicates of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import title_key

#: Forms of paper identifiers.
ARXIV = r"(?:arxiv\.org/(?:abs|pdf)/|arxiv:\s*|^)([0-9]{4}\.[0-9]{4,5})(v[0-9]+)?"
DOI = r"(10\.[0-9]{4,9}/[^\s\"<>?#]+)"


def duplicates(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """incoming(id, title, body) against library(id, title, body, updated_at): the earliest
    item of equal text (`content`), else of equal title key (`title`). Texts are
    compared by digest, so that they don't cross the network."""
    new = incoming.select("id", F.sha2("body", 256).alias("digest"), title_key(F.col("title")).alias("key"))
    old = library.select(F.col("id").alias("match_id"), "updated_at", F.sha2("body", 256).alias("digest"), title_key(F.col("title")).alias("key"))
    first = F.min(F.struct("updated_at", "match_id"))["match_id"].alias("match_id")
    by_text = new.join(old.groupBy("digest").agg(first), "digest").select("id", F.lit("content").alias("reason"), "match_id")
    by_title = new.where("key <> ''").join(old.groupBy("key").agg(first), "key").select("id", F.lit("title").alias("reason"), "match_id")
    return by_text.unionByName(by_title.join(by_text, "id", "left_anti"))


#: An arXiv id, alone or in an address of the site, and what ends one.
ARXIV_ID = r"((?:[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[a-z-]+)?/[0-9]{7}))(v[1-9][0-9]*)?"
ARXIV_FORM = rf"^(?:arxiv\s*:\s*)?(?:https?://(?:www\.|export\.)?arxiv\.org/(?:(?:abs|pdf|html)/)?)?{ARXIV_ID}(?:\.pdf)?/?(?:[?#].*)?$"
DOI_FORM = r"^(?:doi\s*:\s*)?(?:https?://(?:dx\.)?doi\.org/)?(10\.[0-9]{4,9}/[^\s<>?#]+)(?:[?#].*)?$"


def paper_record(text: Column) -> Column:
    """struct(identity, version, canonical_url, source_url, pdf_url) of an identifier or address
    of a paper; null for others. Versions of an arXiv paper are one paper, whose source
    keeps the version that was asked for; a DOI keeps what looks like one."""
    t = F.lower(F.trim(text))
    arxiv, version, doi = F.regexp_extract(t, ARXIV_FORM, 1), F.regexp_extract(t, ARXIV_FORM, 2), F.regexp_extract(t, DOI_FORM, 1)
    none = F.lit(None).cast("string")
    page = lambda kind, v: F.concat(F.lit(f"https://arxiv.org/{kind}/"), arxiv, v)
    fields = ("identity", "version", "canonical_url", "source_url", "pdf_url")
    of_arxiv = (F.concat(F.lit("arxiv:"), arxiv), version, page("abs", F.lit("")), page("abs", version), page("pdf", version))
    of_doi = (F.concat(F.lit("doi:"), doi), none, F.concat(F.lit("https://doi.org/"), doi), none, none)
    named = lambda values: F.struct(*(v.alias(n) for v, n in zip(values, fields, strict=True)))
    return F.when(arxiv != "", named(of_arxiv)).when(doi != "", named(of_doi))


def paper_identity(text: Column) -> Column:
    """arxiv:<id> or doi:<doi> of any form of either; null for others."""
    t = F.trim(F.lower(text))
    arxiv = F.regexp_extract(t, ARXIV, 1)
    doi = F.regexp_replace(F.regexp_extract(t, DOI, 1), r"[.,;)]+$", "")
    return F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)).when(doi != "", F.concat(F.lit("doi:"), doi))


def identity_groups(rows: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    """Rows whose key others have too, a row each: key, id, the group's size and its first id.
    A group may be as large as it likes; nothing gathers it."""
    named = rows.where(F.col(key).isNotNull()).select(key, id_column)
    groups = named.groupBy(key).agg(F.count("*").alias("n"), F.min(id_column).alias("first_id")).where("n > 1")
    return named.join(groups, key).select(key, id_column, "n", "first_id")


def video_identity(url: Column) -> Column:
    """platform:id of a video url in its several forms; null for others."""
    youtube = F.regexp_extract(url, r"(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    bilibili = F.regexp_extract(url, r"bilibili\.com/video/(BV[A-Za-z0-9]{10})", 1)
    return F.when(youtube != "", F.concat(F.lit("youtube:"), youtube)).when(bilibili != "", F.concat(F.lit("bilibili:"), bilibili))


def repository_identity(url: Column) -> Column:
    """owner/name of a repository url, without .git; null for others."""
    name = F.regexp_replace(F.regexp_extract(url, r"^(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9-]+/[A-Za-z0-9._-]+)", 1), r"\.git$", "")
    return F.when(name != "", name)


def public_url(url: Column) -> Column:
    """http(s) urls without credentials whose host isn't a private or reserved IPv4
    address, or local."""
    host = F.regexp_extract(url, r"^https?://([^/?#:@]+)(?::[0-9]+)?(?:[/?#]|$)", 1)
    octet = [F.regexp_extract(host, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", i).try_cast("int") for i in (1, 2)]
    a, b = octet
    private = a.isNotNull() & (a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)))
    return (host != "") & ~host.isin("localhost") & ~host.endswith(".localhost") & ~host.endswith(".local") & ~private
