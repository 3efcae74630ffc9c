"""What a user of the library needs, and analysers by language."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from codestrata.operators import chunks as _chunks
from codestrata.operators.importing import Options, Store, copy_branch, import_edges, import_incremental, import_nodes, import_simple
from codestrata.operators.traverse import DOWNSTREAM, UPSTREAM, closure, seeds, summary, visited
from codestrata.sources import java_facts
from codestrata.sources.files import configuration_chunks, read_chunk_arrays, read_chunks, source_files, write_chunk_array, write_chunks
from codestrata.sources.store import load, save

__all__ = [
    "ANALYZERS", "Analyzer", "DOWNSTREAM", "Options", "Store", "UPSTREAM", "analyzer", "closure", "configuration_chunks", "copy_branch", "import_edges", "import_incremental", "import_nodes", "import_simple", "load",
    "read_chunk_arrays", "read_chunks", "save", "seeds", "source_files", "summary", "visited", "write_chunk_array", "write_chunks",
]


class Analyzer(Protocol):
    """What a language must offer: its files' pattern, and facts (as java_facts.SCHEMA has them) out of files (file_id, content)."""

    pattern: str

    def facts(self, files: DataFrame) -> DataFrame: ...

    def chunks(self, files: DataFrame, project_id: str | int, branch: str) -> DataFrame: ...


class JavaAnalyzer:
    """Chunks of Java files (file_id, file_path, content)."""

    pattern = "*.java"

    def facts(self, files: DataFrame) -> DataFrame:
        return java_facts.extract(files)

    def chunks(self, files: DataFrame, project_id: str | int, branch: str) -> DataFrame:
        return _chunks.build(self.facts(files), project_id, branch, files)


#: Analysers by language; further ones may be added.
ANALYZERS: dict[str, type[Analyzer]] = {"java": JavaAnalyzer}


def analyzer(language: str) -> Analyzer:
    """The analyser of a language, in any letter case."""
    found = ANALYZERS.get(language.lower())
    if found is None:
        raise ValueError(f"no analyser for {language!r}; there are {sorted(ANALYZERS)}")
    return found()
