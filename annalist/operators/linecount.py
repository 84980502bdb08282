"""Code, comment and blank lines per language."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist import schemas
from annalist.operators import syntax
from annalist.operators.sections import file_ext
from annalist.sources import manifest as manifests, workers

# Extension or whole file name in lower case, language name, line-comment
# prefixes, and whether every line of text counts as a comment.
_SLASH, _HASH, _MARKUP = ("//",), ("#",), ("<!--",)
_GROUPS = (
    (_SLASH, "c:c cc:c++ cpp:c++ cxx:c++ hpp:c++_header hh:c++_header h:c_header cs:c# cu:cuda"
             " dart:dart go:go gradle:gradle groovy:groovy java:java js:javascript mjs:javascript"
             " cjs:javascript jsx:jsx kt:kotlin kts:kotlin less:less m:objective-c mm:objective-c++"
             " proto:protocol_buffers rs:rust scala:scala scss:sass swift:swift ts:typescript"
             " tsx:tsx v:verilog zig:zig sol:solidity jsonc:json_with_comments"),
    (_HASH, "py:python pyi:python rb:ruby sh:shell bash:bash zsh:zsh fish:fish pl:perl pm:perl"
            " r:r jl:julia ex:elixir exs:elixir toml:toml yaml:yaml yml:yaml tf:terraform tcl:tcl"
            " nix:nix cmake:cmake mk:makefile conf:configuration makefile:makefile"
            " dockerfile:dockerfile gemfile:ruby rakefile:ruby cmakelists.txt:cmake awk:awk"
            " ps1:powershell nim:nim coffee:coffeescript graphql:graphql properties:properties"),
    (_MARKUP, "html:html htm:html xml:xml xhtml:xml xsl:xsl svg:svg vue:vue svelte:svelte"),
    (("/*",), "css:css"),
    (("--",), "sql:sql lua:lua hs:haskell elm:elm ada:ada adb:ada ads:ada vhd:vhdl"),
    (("//", "#"), "php:php"),
    (("rem ", "::"), "bat:batch cmd:batch"),
    (("%",), "erl:erlang hrl:erlang tex:tex"),
    ((";",), "lisp:lisp el:emacs_lisp clj:clojure cljs:clojurescript scm:scheme asm:assembly"
             " ini:ini"),
    (('"',), "vim:vim_script"),
    (("!",), "f90:fortran_modern f95:fortran_modern"),
    (("{",), "pas:pascal"),
    (("(*",), "ml:ocaml mli:ocaml fs:f#"),
    ((), "json:json csv:csv ipynb:jupyter_notebooks s:assembly"),
)
_PROSE = "md:markdown markdown:markdown txt:plain_text rst:restructuredtext adoc:asciidoc org:org"
LANGUAGES = tuple(
    (*(x.replace("_", " ") if i else x for i, x in enumerate(pair.split(":"))), prefixes, prose)
    for prefixes, pairs, prose in (
        *((prefixes, pairs, False) for prefixes, pairs in _GROUPS),
        ((), _PROSE, True),
    )
    for pair in pairs.split()
)


def count_lines(
    sources: DataFrame,
    languages: Sequence[tuple] = LANGUAGES,
    other_prefixes: "Sequence[str] | None" = None,
) -> DataFrame:
    """``repo_name, ext, code, comments, blanks`` from whole source texts.

    ``sources`` has ``repo_name, path, text``; ``ext`` in the result is the lower-case
    language name, as in the ``snapshot`` table. The whole file name decides before the
    extension does, both in lower case. Files of no listed language are skipped, unless
    ``other_prefixes`` gives comment prefixes for them; then each unlisted extension counts as
    a language of that name. ``skipped_files`` counts what is left out. Line, block and nested
    block comments are followed, and markers inside strings are none; see ``syntax``.

    The language is looked up in a constant, so the texts are neither joined nor shuffled.
    Lines are counted inside the row of their file, in batches, and only totals reach the
    aggregation.
    """

    spark = sources.sparkSession
    workers.ship(spark)
    known = (
        sources.filter(F.col("text") != "")
        .select("repo_name", F.lower(file_ext("path")).alias("__ext"), _name().alias("__name"), "text")
        .select("repo_name", _language(languages, other_prefixes).alias("__language"), "text")
        .filter(F.col("__language").isNotNull())
        .select("repo_name", "__language.language", "__language.prefixes", "__language.prose", "text")
    )
    per_file = known.mapInArrow(_counted, "repo_name string, ext string, lines long, comments long, blanks long")
    return per_file.groupBy("repo_name", "ext").agg(
        F.sum(F.col("lines") - F.col("comments") - F.col("blanks")).alias("code"),
        F.sum("comments").alias("comments"),
        F.sum("blanks").alias("blanks"),
    )


# Bytes of source text whose lines are classified at once.
_AT_ONCE = 4_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line counts of each file of a batch."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False)
        # Only the files of one part are Python objects at a time.
        parts = np.cumsum(sizes) // _AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges[:-1], edges[1:]):
            if start == stop:
                continue
            repos, names, prefixes, prose, texts = batch.slice(start, stop - start).columns
            names = [x.lower() for x in names.to_pylist()]
            kinds = zip(names, prefixes.to_pylist(), prose.to_pylist())
            own = [syntax.of(n, tuple(p), q) for n, p, q in kinds]
            counts = syntax.count(texts.cast(pa.binary()).to_pylist(), own)
            columns = [repos.cast(pa.string()), pa.array(names, pa.string()), *(pa.array(x, pa.int64()) for x in counts)]
            yield pa.RecordBatch.from_arrays(columns, ["repo_name", "ext", "lines", "comments", "blanks"])
        pa.default_memory_pool().release_unused()


def _name() -> Column:
    """The last part of a path, in lower case."""
    return F.lower(F.substring_index("path", "/", -1))


def _language(languages: Sequence[tuple], other_prefixes: "Sequence[str] | None") -> Column:
    """Language, comment prefixes and kind for ``__name`` and ``__ext``, looked up in a constant."""

    def entry(language, prefixes, prose):
        texts = F.array(*[F.lit(p) for p in prefixes]).cast("array<string>")
        return F.struct(
            language.alias("language"), texts.alias("prefixes"), F.lit(prose).alias("prose")
        )

    language = F.lit(None)
    if languages:
        pairs = [
            column
            for ext, name, prefixes, prose in languages
            for column in (F.lit(ext), entry(F.lit(name), prefixes, prose))
        ]
        table = F.create_map(*pairs)
        language = F.coalesce(table[F.col("__name")], table[F.col("__ext")])
    if other_prefixes is not None:
        language = F.coalesce(language, entry(F.col("__ext"), other_prefixes, False))
    return language


def skipped_files(sources: DataFrame, languages: Sequence[tuple] = LANGUAGES) -> DataFrame:
    """``repo_name, ext, files``: files with text of no listed language."""
    named = sources.filter(F.col("text") != "").select(
        "repo_name", F.lower(file_ext("path")).alias("__ext"), _name().alias("__name")
    )
    return (
        named.filter(_language(languages, None).isNull())
        .groupBy("repo_name", F.col("__ext").alias("ext"))
        .agg(F.count(F.lit(1)).alias("files"))
    )


def snapshot(counts: DataFrame, heads: DataFrame, manifest: DataFrame) -> DataFrame:
    """The ``snapshot`` table: line counts dated with the head commit of their repository."""
    return manifests.with_branch(counts.join(heads, "repo_name"), manifest).select(
        *schemas.columns(schemas.SNAPSHOT)
    )
