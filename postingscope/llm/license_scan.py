"""License scans (operator 7): sparse TF-IDF cosine to templates, then inheritance along directories.

A file is compared with short declarations, full licence headers and full licence texts (words are letters and
digits, lower case, so comment marks and line ends do not count):

* notices (declarations and headers, MIT, BSD and ISC texts): every line, and from every line on the shortest run
  of lines that holds as many words as the notice;
* texts (whole licences): the whole file.

idf(w) = ln((files + templates + 1) / (files and templates that hold w + 1)) + 1 is taken from all files and the
templates, for every word.  The best template at or above `threshold` declares the file's licence.

Two steps lose nothing.  A cosine is at most the root of the squared weights of the template's words that the
file holds, so only files that hold enough of a template's anchors (its heaviest words, all but a tenth of the
squared weights) are compared.  A run's dot product is a sum over its
lines, and its norm is at least the root of the sum of squared weights of its words (at least 1 each); runs
whose quotient of the two reaches the threshold get their exact norm.

A file without a declaration inherits from the nearest ancestor directory that has a licence: directories of
files x their ancestors is an equi-join on the path.  The number of rows is that of directories times their
depth, never that of files squared.

Defined cases: null paths and texts declare nothing and inherit nothing from "" unless the root has a licence
file; ties go to the first template, in a directory to the smallest path; files that share a path keep a row each and
the licence of their own text; an empty table gives an empty result.  DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postingscope.llm.common import cut, per_key

LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"     # names of files that speak for their directory

THRESHOLD = 0.6
REST = 0.1                  # squared weight of a template that its anchors leave out
# short statements by which a file declares its licence
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def _gnu(kind: str, version: str) -> str:
    """The notice that the GNU licences ask for in every file."""
    old = version in ("2", "2.1")
    short = "library" if kind == "Lesser " and old else "program"
    says = "" if old else " of the License"
    where = (f"if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
             if old else "If not, see <https://www.gnu.org/licenses/>.")
    return (f"This {short} is free software{';' if old else ':'} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public "
            f"License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
            f"This {short} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. "
            f"You should have received a copy of the GNU {kind}General Public License along with this {short}{';' if old else '.'} {where}")


_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")
_BSD3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. ")
# what files carry at their head, and licence texts short enough for it
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
                   "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."),
    ("GPL-2.0", _gnu("", "2")),
    ("GPL-3.0", _gnu("", "3")),
    ("LGPL-2.1", _gnu("Lesser ", "2.1")),
    ("LGPL-3.0", _gnu("Lesser ", "3")),
    ("AGPL-3.0", _gnu("Affero ", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
            "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
            "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
            "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD2 + _DISCLAIMER),
    ("BSD-3-Clause", _BSD2 + _BSD3 + _DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
            "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
            "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
            "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
            "PERFORMANCE OF THIS SOFTWARE."),
)
# whole licences, by file of the folder licenses/
TEXTS = (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"),
         ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3"), ("Artistic-1.0", "Artistic"))


@cache
def licence_texts() -> tuple[tuple[str, str], ...]:
    """(name, text) of the whole licences; only the driver reads them."""
    folder = Path(__file__).parent / "licenses"
    return tuple((name, (folder / f"{file}.txt").read_text(encoding="utf-8")) for name, file in TEXTS)


def words_of(s: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", s.lower())


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


class Weights:
    """Template vectors, idf and anchors: notices first, then whole texts.

    files and df (word to number of files) come from the corpus; without them the templates are the corpus.
    """

    def __init__(self, templates=TEMPLATES + HEADERS, threshold: float = THRESHOLD, texts=None, files: int = 0, df: dict[str, int] | None = None):
        whole = licence_texts() if texts is None else texts
        self.notices = len(templates)
        self.names = [n for n, _ in (*templates, *whole)]
        bags = [Counter(words_of(t)) for _, t in (*templates, *whole)]
        self.lengths = [sum(b.values()) for b in bags]
        self.total = files + len(bags)
        own = Counter(w for b in bags for w in b)
        self.idf = {w: self.weight(n + (df or {}).get(w, 0)) for w, n in own.items()}
        vectors = [{w: n * self.idf[w] for w, n in b.items()} for b in bags]
        norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
        self.vectors = [{w: x / z for w, x in v.items()} for v, z in zip(vectors, norms)]
        self.least: list[tuple[float, list[tuple[str, float]]]] = []   # per template: anchors' weight needed, anchors
        for v in self.vectors:
            rest, heavy = 1.0, []
            for w in sorted(v, key=lambda w: (-v[w], w)):
                if rest < min(REST, threshold ** 2 / 2):
                    break
                heavy.append((w, v[w] ** 2))
                rest -= v[w] ** 2
            self.least.append((threshold ** 2 - max(rest, 0.0) - 1e-6, heavy))
        self.anchors = sorted({w for _, heavy in self.least for w, _ in heavy})

    def may_declare(self, words: Column) -> Column:
        """Whether a file with these words holds enough of some template's anchors."""
        table = F.array(*[F.struct(F.lit(x).alias("least"), F.array(*[F.struct(F.lit(a).alias("a"), F.lit(y).alias("y")) for a, y in heavy]).alias("heavy"))
                          for x, heavy in self.least])

        def enough(held: Column) -> Column:
            return F.exists(table, lambda t: F.aggregate(
                t["heavy"], F.lit(0.0), lambda sum_, s: sum_ + F.when(F.array_contains(held, s["a"]), s["y"]).otherwise(0.0)) >= t["least"])

        held = F.array(F.array_intersect(words, F.array(*[F.lit(a) for a in self.anchors])))    # in an array: evaluated once
        return F.coalesce(F.get(F.transform(held, enough), F.lit(0)), F.lit(False))

    def weight(self, n: int) -> float:
        return math.log((self.total + 1) / (n + 1)) + 1


def _corpus(docs: DataFrame) -> tuple[int, DataFrame]:
    """Number of files and (word, df) of all their words."""
    df = docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return docs.count(), cut(df)


def declared(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES + HEADERS, threshold: float = THRESHOLD, texts=None) -> DataFrame:
    """(path, body, license, score, line) of every distinct file (path and text, whose hash is `body`) that declares a licence."""
    spark = files.sparkSession
    docs = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text"))
    n_files, df = _corpus(docs)
    own = spark.createDataFrame([(x,) for x in Weights(templates, threshold, texts).idf], "term string")
    known = {r.word: r.df for r in df.join(F.broadcast(own), F.expr("word = term")).select("word", "df").collect()}
    w = Weights(templates, threshold, texts, n_files, known)
    # sparse vectors: one row per word; the weights are as many rows as the templates have words
    table = [(x, float(i), [float(v.get(x, 0.0)) for v in w.vectors]) for x, i in sorted(w.idf.items())]
    weights = F.broadcast(spark.createDataFrame(table, "term string, idf double, parts array<double>"))
    held = cut(docs.where(w.may_declare(_words(F.col("text"))))      # few files; read three times
               .withColumn("body", body_of(F.col("text"))).dropDuplicates(["path", "body"]))

    # per line: words before it, and the sums of which runs of lines are made
    file = Window.partitionBy("path", "body")
    lines = (held.select("path", "body", F.posexplode(F.split("text", "\n")).alias("line", "t"))
             .select("path", "body", "line", _words(F.col("t")).alias("words")).where("size(words) > 0")
             .withColumn("nw", F.size("words").cast("bigint"))
             .withColumn("off", F.coalesce(F.sum("nw").over(file.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")))
    every = range(len(w.names))
    sums = (lines.select("path", "body", "line", "off", "nw", F.explode("words").alias("word"))
            .join(weights, F.expr("word = term"), "left").groupBy("path", "body", "line", "off", "nw")
            .agg(F.sum(F.coalesce(F.col("idf") * F.col("idf"), F.lit(1.0))).alias("sq"),
                 *[F.sum(F.coalesce(F.col("idf") * F.get("parts", F.lit(k)), F.lit(0.0))).alias(f"dot{k}") for k in every]))
    whole = file.orderBy("off").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frames = {n: file.orderBy("off").rangeBetween(0, n - 1) for n in sorted(set(w.lengths[:w.notices]))}
    runs = sums.select(
        "path", "body", "line", "off", "nw", "sq", *[F.col(f"dot{k}") for k in range(w.notices)],
        *[F.sum("nw").over(f).alias(f"len_{n}") for n, f in frames.items()], *[F.sum("sq").over(f).alias(f"sq_{n}") for n, f in frames.items()],
        *[F.sum(f"dot{k}").over(frames[w.lengths[k]]).alias(f"run{k}") for k in range(w.notices)],
        F.sum("nw").over(whole).alias("len_all"), F.sum("sq").over(whole).alias("sq_all"),
        *[F.sum(f"dot{k}").over(whole).alias(f"all{k}") for k in every if k >= w.notices])

    def unit(k: int, length: str, sq: str, dot: str) -> Column:
        return F.struct(F.lit(k).alias("k"), F.col(length).alias("len"), F.col(sq).alias("sq"), F.col(dot).alias("dot"))

    notices = [u for k in range(w.notices) for u in (unit(k, "nw", "sq", f"dot{k}"), unit(k, f"len_{w.lengths[k]}", f"sq_{w.lengths[k]}", f"run{k}"))]
    texts_ = [unit(k, "len_all", "sq_all", f"all{k}") for k in every if k >= w.notices]
    some = F.array(*notices)
    if texts_:
        some = F.when(F.col("off") == 0, F.array(*notices, *texts_)).otherwise(some)
    near = cut(runs.select("path", "body", "line", "off", F.explode(F.filter(
        some, lambda u: u["dot"] >= F.lit(threshold - 1e-6) * F.sqrt(u["sq"]))).alias("u"))
        .select("path", "body", "line", "off", "u.k", "u.len", "u.dot").distinct())

    # exact norms, once per distinct run of words
    spans = (near.select("path", "body", "off", "len").distinct()
             .join(held.select(F.col("path").alias("p"), F.col("body").alias("b"), _words(F.col("text")).alias("words")), F.expr("path = p and body = b"))
             .select("path", "body", "off", "len", F.slice("words", (F.col("off") + 1).cast("int"), F.col("len").cast("int")).alias("words"))
             .withColumn("h", F.sha2(F.array_join(F.array_sort("words"), " "), 256)))
    bags = (spans.select("h", "words").dropDuplicates(["h"]).select("h", F.explode("words").alias("word"))
            .groupBy("h", "word").agg(F.count(F.lit(1)).alias("tf")).join(weights.select("term", "idf"), F.expr("word = term"), "left"))
    seen = df.select(F.col("word").alias("seen"), (F.log(F.lit(w.total + 1) / (F.col("df") + 1)) + 1).alias("i"))
    # only words outside the templates look for their idf; the others have a key that no word has
    key = F.when(F.col("idf").isNull(), F.col("word")).otherwise(F.concat(F.lit(" "), F.col("h")))
    x = F.col("tf") * F.coalesce("idf", "i")
    parts = bags.withColumn("key", key).join(seen, F.expr("key = seen"), "left").select("h", (x * x).alias("x2"))
    norms = parts.groupBy(F.col("h").alias("nh")).agg(F.sqrt(F.sum("x2")).alias("norm"))
    exact = (spans.drop("words").join(norms, F.expr("h = nh"))
             .select(F.col("path").alias("p"), F.col("body").alias("b"), F.col("off").alias("o"), F.col("len").alias("l"), "norm"))
    scored = (near.join(exact, F.expr("path = p and body = b and off = o and len = l"))
              .select("path", "body", "line", F.round(F.col("dot") / F.col("norm"), 9).alias("score"), (-F.col("k")).alias("k")).where(F.col("score") >= threshold))
    names = F.array(*[F.lit(n) for n in w.names])
    return (scored.groupBy("path", "body").agg(F.max(F.struct("score", "k", (-F.col("line")).alias("line"))).alias("b"))
            .select("path", "body", F.get(names, -F.col("b.k")).alias("license"), F.col("b.score").alias("score"), (-F.col("b.line")).alias("line")))


def cut_declared(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES + HEADERS, threshold: float = THRESHOLD, texts=None) -> DataFrame:
    """declared(), written to the shared folder: both the file's own licence and its directory's read it."""
    return cut(declared(files, path, text, templates, threshold, texts))


def body_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(files: DataFrame, own: DataFrame, licence_files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per file: the columns `keep`, path, own license and score, effective license and the directory it comes from (null: its own).

    own: (path, body, license, score) from `declared`; licence_files: (path, license) of the files that speak for their directory.
    """
    dirs = (licence_files.withColumn("dir", parent(F.col("path"))).groupBy("dir")
            .agg(F.min(F.struct("path", "license")).alias("m")).select("dir", F.col("m.license").alias("dir_license")))
    mine = cut(files.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.col(path).alias("path"), body_of(F.col(text)).alias("body"))
               .withColumn("own_dir", parent(F.col("path"))))
    # directories, not files, look for their nearest licensed ancestor
    held = mine.where("own_dir is not null").groupBy("own_dir").agg(F.count(F.lit(1)).alias("files"))
    parts = F.split("own_dir", "/")
    up = (held.withColumn("depth", F.explode(F.sequence(F.lit(0), F.when(F.col("own_dir") == "", 0).otherwise(F.size(parts)))))
          .withColumn("dir", F.array_join(F.slice(parts, 1, F.col("depth")), "/")))
    near = (up.join(dirs, "dir").groupBy("own_dir", "files").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("n"))
            .select("own_dir", "files", F.col("n.dir").alias("from_dir"), F.col("n.dir_license").alias("dir_license")))
    total = mine.count()
    placed = per_key(mine, near, ["own_dir"], "files", total)       # one directory may hold a third of all files
    o = own.select(F.col("path").alias("p"), F.col("body").alias("b"), "license", "score")
    return (placed.join(o, F.expr("path = p and body = b"), "left")
            .select(*[F.col(f"keep_{c}").alias(c) for c in keep], "path", F.col("license").alias("own_license"), "score",
                    F.coalesce("license", "dir_license").alias("license"), F.when(F.col("license").isNull(), F.col("from_dir")).alias("inherited_from")))


def license_scan(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES + HEADERS, threshold: float = THRESHOLD,
                 licence_file: str = LICENCE_FILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Licences of files; those whose name says so speak for their directory and all below it without one of their own."""
    own = cut_declared(files, path, text, templates, threshold)
    return inherit(files, own, own.where(F.col("path").rlike(licence_file)), path, text, keep)


def document_tree(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, path, text): documents as files of a tree without paths of its own.

    Roots are sources, below them languages; a document lies below the leading digits of its id, one directory a digit, so that depths
    differ (12 in source/lang/1, 1234 in source/lang/1/2/3).  A document is called by its id, but for the directory's own entry, whose
    last digit is 0: it is the directory's licence file, by name.  A null id lies at the language; a slash in a source or language is
    written as a colon.  A projection: no text is moved."""
    part = [F.translate(F.coalesce(F.col(c).cast("string"), F.lit("_")), "/", ":") for c in (source, lang)]
    digits = F.abs(F.col(id_col).cast("bigint")).cast("string")
    folders = F.split(F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 1, F.lit(0))), "")
    folder = F.concat_ws("/", *part, F.array_remove(folders, ""))
    name = F.when(F.substring(digits, -1, 1) == "0", "LICENSE").otherwise(F.coalesce(F.col(id_col).cast("string"), F.lit("none")))
    return docs.select(F.col(id_col).alias("doc_id"), F.concat_ws("/", folder, name).alias("path"), F.col(text).alias("text"))
