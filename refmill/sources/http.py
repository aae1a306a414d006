"""Catalogues over HTTP: requests with retries, and what their answers hold.

Each task asks for its own rows; a failing catalogue gives no hits and never fails the job.
"""

from __future__ import annotations

import json
import random
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from typing import Any
from urllib.error import HTTPError

import pandas as pd
from pyspark.sql import DataFrame

# What is tried again, how often and how long.
RETRIED = frozenset({429, 500, 502, 503, 504})
ATTEMPTS, BASE_SECONDS, TIMEOUT_SECONDS, HITS = 3, 0.5, 12, 5


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds of a Retry-After header, given as seconds or a date; null unless positive."""
    if not value:
        return None
    try:
        seconds = float(value)
    except ValueError:
        try:
            seconds = parsedate_to_datetime(value).timestamp() - now
        except (TypeError, ValueError):
            return None
    return seconds if seconds > 0 else None


def _open(url: str) -> tuple[int, str | None, str]:
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT_SECONDS) as r:  # noqa: S310  https addresses of catalogues
            return r.status, None, r.read().decode()
    except HTTPError as e:
        return e.code, e.headers.get("Retry-After"), ""


def fetch_json(url: str, opener: Callable[[str], tuple[int, str | None, str]] = _open, wait: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> Any:
    """The answer, or None for a refusal or once the attempts are used up; never raises."""
    for n in range(1, attempts + 1):
        after = None
        try:
            status, header, body = opener(url)
            if 200 <= status < 300:
                return json.loads(body)
            if status not in RETRIED:
                return None
            after = retry_after(header, time.time())
        except Exception:  # noqa: BLE001  network errors and bad JSON are retried alike
            pass
        if n < attempts:
            wait(after if after is not None else BASE_SECONDS * (2 ** (n - 1) + random.random()))  # noqa: S311
    return None


def _year(text: Any) -> int | None:
    digits = "".join(c if c.isdigit() else " " for c in str(text or "")).split()
    return next((int(d) for d in digits if len(d) == 4), None)


def _openalex(q: dict) -> str | None:
    if len(q["title"]) < 5:
        return None
    params = {"search": q["title"].strip(), "per_page": HITS} | ({"filter": f"publication_year:{q['year']}"} if q.get("year") else {})
    return "https://api.openalex.org/works?" + urllib.parse.urlencode(params)


def _openalex_hits(data: dict, q: dict) -> list[dict]:
    source = lambda w: ((w.get("primary_location") or {}).get("source") or {}).get("display_name") or ""
    names = lambda w: [n for a in w.get("authorships") or [] if (n := (a.get("author") or {}).get("display_name"))]
    return [{"title": w.get("title") or "", "authors": names(w), "year": w.get("publication_year"), "doi": (w.get("doi") or "").replace("https://doi.org/", "") or None, "journal": source(w), "isbn": None} for w in data.get("results") or []]


def _crossref(q: dict) -> str | None:
    if len(q["title"]) < 5:
        return None
    return "https://api.crossref.org/works?" + urllib.parse.urlencode({"query.bibliographic": q["title"], "rows": HITS} | ({"query.author": q["author"]} if q.get("author") else {}))


def _crossref_hits(data: dict, q: dict) -> list[dict]:
    date = lambda w: (((w.get("published") or w.get("created") or {}).get("date-parts") or [[None]])[0] or [None])[0]
    name = lambda a: ", ".join(x for x in (a.get("family"), a.get("given")) if x)
    first = lambda v: (v or [""])[0]
    return [{"title": first(w.get("title")), "authors": [n for a in w.get("author") or [] if (n := name(a))], "year": date(w), "doi": w.get("DOI"), "journal": first(w.get("container-title")), "isbn": (w.get("ISBN") or [None])[0]} for w in (data.get("message") or {}).get("items") or []]


def _openlibrary(q: dict) -> str | None:
    if q.get("isbn"):
        return "https://openlibrary.org/search.json?" + urllib.parse.urlencode({"isbn": q["isbn"], "limit": HITS})
    if len(q["title"]) < 4:
        return None
    return "https://openlibrary.org/search.json?" + urllib.parse.urlencode({"title": q["title"], "limit": HITS} | ({"author": q["author"]} if q.get("author") else {}))


def _openlibrary_hits(data: dict, q: dict) -> list[dict]:
    """A work without a year takes the query's own."""
    return [{"title": w.get("title") or "", "authors": w.get("author_name") or [], "year": w.get("first_publish_year") or q.get("year"), "doi": None, "journal": (w.get("publisher") or [""])[0], "isbn": (w.get("isbn") or [None])[0]} for w in data.get("docs") or []]


def _googlebooks(q: dict) -> str | None:
    if len(q["title"]) < 4 and not q.get("isbn"):
        return None
    terms = f"isbn:{q['isbn']}" if q.get("isbn") else f"intitle:{q['title']}" + (f" inauthor:{q['author']}" if q.get("author") else "")
    return "https://www.googleapis.com/books/v1/volumes?" + urllib.parse.urlencode({"q": terms, "maxResults": HITS})


def _googlebooks_hits(data: dict, q: dict) -> list[dict]:
    out = []
    for item in data.get("items") or []:
        v = item.get("volumeInfo") or {}
        numbers = {i.get("type"): i.get("identifier") for i in v.get("industryIdentifiers") or []}
        out.append({"title": ": ".join(x for x in (v.get("title"), v.get("subtitle")) if x), "authors": v.get("authors") or [], "year": _year(v.get("publishedDate")), "doi": None, "journal": v.get("publisher") or "", "isbn": numbers.get("ISBN_13") or numbers.get("ISBN_10")})
    return out


def _semanticscholar(q: dict) -> str | None:
    if len(q["title"]) < 5:
        return None
    return "https://api.semanticscholar.org/graph/v1/paper/search?" + urllib.parse.urlencode({"query": q["title"], "limit": HITS, "fields": "title,authors,year,venue,externalIds"} | ({"year": q["year"]} if q.get("year") else {}))


def _semanticscholar_hits(data: dict, q: dict) -> list[dict]:
    return [{"title": p.get("title") or "", "authors": [a["name"] for a in p.get("authors") or [] if a.get("name")], "year": p.get("year"), "doi": (p.get("externalIds") or {}).get("DOI"), "journal": p.get("venue") or "", "isbn": None} for p in data.get("data") or []]


#: In order of their rank: address of a query, hits of an answer. Further catalogues are added here.
CATALOGUES: dict[str, tuple[Callable[[dict], str | None], Callable[[dict, dict], list[dict]]]] = {
    "OpenAlex": (_openalex, _openalex_hits),
    "Crossref": (_crossref, _crossref_hits),
    "Open Library": (_openlibrary, _openlibrary_hits),
    "Google Books": (_googlebooks, _googlebooks_hits),
    "Semantic Scholar": (_semanticscholar, _semanticscholar_hits),
}
SCHEMA = "ref_idx long, api_rank int, hit_rank int, source string, title string, authors array<string>, year int, doi string, journal string, isbn string"


def candidates(refs: DataFrame, fetch: Callable[[str], Any] = fetch_json, catalogues: tuple[str, ...] = tuple(CATALOGUES), pause: float = 0.3) -> DataFrame:
    """Hits of (ref_idx, title, authors, year, isbn) in every catalogue, asked by title, first author, year and ISBN."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                year = None if r.year is None or r.year != r.year else int(r.year)
                q = {"title": r.title or "", "author": r.authors[0] if r.authors is not None and len(r.authors) else None, "year": year, "isbn": r.isbn}
                for rank, name in enumerate(catalogues):
                    address, hits = CATALOGUES[name]
                    url = address(q)
                    answer = fetch(url) if url else None
                    rows += [{"ref_idx": r.ref_idx, "api_rank": rank, "hit_rank": i, "source": name} | h for i, h in enumerate((hits(answer, q) if answer else [])[:HITS])]
                time.sleep(pause)
            out = pd.DataFrame(rows, columns=["ref_idx", "api_rank", "hit_rank", "source", "title", "authors", "year", "doi", "journal", "isbn"])
            yield out.astype({"year": "Int32"})

    return refs.select("ref_idx", "title", "authors", "year", "isbn").mapInPandas(run, SCHEMA)
