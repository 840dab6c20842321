"""Source files that Spark derives from the given tables: a file for each part, with a type that holds and calls the parts it is followed by in orders.

The files of a part are in the language that its key says. Each has what patterns get wrong (declarations in comments and in raw, template or
nested texts), and the same members in every language: type C<key>, a field f<other> of type C<other> for each edge, and a method run<key> that calls run<other> on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.tables import register

#: Language: ending, text around the members, a field, a call. {k} is the part, {d} another.
TEMPLATES = {
    "java": ("java", 'package p;\n// class Gone {}\npublic class C{k} {\n{fields}\n  void run{k}() {\n    log("""\n      class Gone { "{" """);\n{calls}\n  }\n}\n', "  private C{d} f{d};", "    this.f{d}.run{d}();"),
    "typescript": ("ts", "/* class Gone {} */\nexport class C{k} {\n{fields}\n  run{k}() {\n    log(`class Gone { ${ '}' + `{` }`);\n{calls}\n  }\n}\n", "  private f{d}: C{d};", "    this.f{d}.run{d}();"),
    "csharp": ("cs", 'namespace P {\n  // class Gone {}\n  public class C{k} {\n{fields}\n    void run{k}() {\n      log(@"class ""Gone"" { ");\n{calls}\n    }\n  }\n}\n', "    private C{d} f{d};", "      this.f{d}.run{d}();"),
    "go": ("go", "package p\n\n// type Gone struct {}\ntype (\n\tC{k} struct {\n{fields}\n\t}\n)\n\nfunc (s *C{k}) run{k}() {\n\tlog(`type Gone struct {`)\n{calls}\n}\n", "\t\tf{d} *C{d}", "\ts.f{d}.run{d}()"),
    "kotlin": ("kt", '/* /* class Gone */ class Gone */\nclass C{k} {\n{fields}\n  fun run{k}() {\n    log("""class Gone { " """)\n{calls}\n  }\n}\n', "  lateinit var f{d}: C{d}", "    this.f{d}.run{d}()"),
    "rust": ("rs", '/* /* struct Gone; */ */\npub(crate) struct C{k} {\n{fields}\n}\nimpl C{k} { pub fn run{k}(&self) {\n    log(r#"struct Gone { " "#);\n{calls}\n} }\n', "  f{d}: C{d},", "    self.f{d}.run{d}();"),
    "php": ("php", "<html>class Gone {<?php\n# class Gone {}\nclass C{k} {\n{fields}\n  function run{k}() {\n    log(<<<'X'\n    class Gone {\n    X);\n{calls}\n  }\n}\n", "  private C{d} $f{d};", "    $this->f{d}->run{d}();"),
    "scala": ("scala", '/* /* class Gone */ */\nclass C{k} {\n{fields}\n  def run{k}() = {\n    log("""class Gone { " """)\n{calls}\n  }\n}\n', "  var f{d}: C{d} = null", "    this.f{d}.run{d}()"),
    "dart": ("dart", "/* /* class Gone {} */ */\nclass C{k} {\n{fields}\n  void run{k}() {\n    log(r'class Gone { \" ');\n{calls}\n  }\n}\n", "  late C{d} f{d};", "    this.f{d}.run{d}();"),
    "cpp": ("cpp", '// class Gone {};\nclass C{k} {\n public:\n{fields}\n  void run{k}() {\n    log(R"x(class Gone { " )x");\n{calls}\n  }\n};\n', "  C{d} *f{d};", "    this->f{d}->run{d}();"),
}
LANGUAGES = list(TEMPLATES)

#: In SQL: the type, file and ids of a part, and the language of its key.
_LANGUAGE = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LANGUAGES)) + " END"
_ENDING = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{TEMPLATES[x][0]}'" for i, x in enumerate(LANGUAGES)) + " END"
CODE = (
    f"code AS (SELECT pk, language, path, concat(path, '::C', CAST(pk AS STRING)) AS type_id, concat(path, '::C', CAST(pk AS STRING), '.run', CAST(pk AS STRING)) AS method_id, concat('C', CAST(pk AS STRING)) AS name, CASE WHEN language IN ('go', 'rust') THEN 'struct' ELSE 'class' END AS kind"
    f" FROM (SELECT p_partkey AS pk, {_LANGUAGE} AS language, concat('src/', {_LANGUAGE}, '/C', CAST(p_partkey AS STRING), '.', {_ENDING}) AS path FROM part) x)"
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text and language of a source file for each part."""
    register(spark, sf_dir)
    of = lambda i: F.create_map(*[x for k, v in TEMPLATES.items() for x in (F.lit(k), F.lit(v[i]))])
    parts = spark.sql(f"WITH {CODE} SELECT pk, path, language FROM code")
    others = spark.sql("SELECT src AS pk, dst FROM edge").groupBy("pk").agg(F.array_sort(F.collect_list("dst")).alias("others"))
    rows = parts.join(others, "pk", "left")
    key = lambda text, name, value: F.replace(text, F.lit(name), value.cast("string"))
    lines = lambda i: F.array_join(F.transform(F.coalesce("others", F.array().cast(others.schema["others"].dataType)), lambda d: key(F.element_at(of(i), F.col("language")), "{d}", d)), "\n")
    text = key(F.replace(F.replace(F.element_at(of(1), F.col("language")), F.lit("{fields}"), lines(2)), F.lit("{calls}"), lines(3)), "{k}", F.col("pk"))
    return rows.select("path", text.alias("text"), "language")
