"""Column types of the library tables, for sources that carry no types of their own."""

from __future__ import annotations

CANONICAL = "struct<doi:string,semanticScholarId:string,arxivId:string,openAlexId:string,title:string,year:int>"
CANDIDATE = f"struct<provider:string,matchedBy:string,confidence:double,canonical:{CANONICAL}>"
ATTEMPT = "struct<provider:string,status:string,message:string,candidatesConsidered:int>"
RESOLUTION = (
    f"struct<status:string,provider:string,matchedBy:string,queriedIdentifier:string,queriedText:string,confidence:double,canonical:{CANONICAL},"
    f"candidates:array<{CANDIDATE}>,resolvedAt:string,attempts:array<{ATTEMPT}>>"
)
REFERENCE = (
    "struct<index:int,label:string,rawText:string,title:string,authors:array<string>,year:int,venue:string,doi:string,arxivId:string,semanticScholarId:string,openAlexId:string,"
    f"url:string,pageStart:int,pageEnd:int,confidence:double,source:string,reviewed:boolean,canonicalReference:{CANONICAL},resolution:{RESOLUTION}>"
)
ENTRY = "struct<method:string,addedAt:timestamp,fileName:string,detail:string,parentPaperId:string>"
PAPER = (
    "id string, citationKey string, title string, authors array<string>, year int, venue string, type string, doi string, semanticScholarId string, openAlexId string, arxivId string, url string, pdfUrl string, "
    "abstract string, publisher string, keywords array<string>, topics array<string>, tags array<string>, notes string, status string, relevance int, starred boolean, citationCount bigint, source string, "
    f"providerPrimary string, metadataSources array<string>, sourceFileName string, libraryEntry {ENTRY}, extractedReferences array<{REFERENCE}>, createdAt timestamp, importedAt timestamp, updatedAt timestamp, "
    "enrichedAt timestamp, extra string"
)
EDGE = "id string, source string, target string, kind string, relation string, provenance string, referenceResolution struct<provider:string,matchedBy:string,resolvedAt:string>, createdAt timestamp, extra string"
TOPIC = "id string, name string, source string, description string, confidence double, createdAt timestamp, extra string"
META = "key string, value string"


def fields(schema: str) -> list[str]:
    """Top-level column names of a DDL schema."""
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out
