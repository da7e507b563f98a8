"""Math markup: every rule, random trees against a plain recursion, and broken XML."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions.omml import ACCENTS, DELIMITERS, OPERATORS, omml_to_latex

from plain_omml import omml_to_latex as plainly

M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def r(x):
    return f"<m:r><m:t>{x}</m:t></m:r>"


def run(spark, xmls):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xmls)], "k int, x string").select("k", omml_to_latex(F.col("x")).alias("y"))
    assert "Python" not in df._jdf.queryExecution().toString()
    return [row.y for row in df.orderBy("k").collect()]


CASES = [
    (f"<m:nary><m:naryPr><m:chr m:val='∫'/></m:naryPr><m:sub>{r('0')}</m:sub><m:sup>{r('1')}</m:sup><m:e>{r('x')}</m:e></m:nary>", "$\\int_{0}^{1} x$"),
    (f"<m:d><m:dPr><m:begChr m:val='['/><m:endChr m:val=']'/></m:dPr><m:e>{r('a')}</m:e><m:e>{r('b')}</m:e></m:d>", "$\\left[ a | b \\right]$"),
    (f"<m:func><m:fName>{r('Sin')}</m:fName><m:e>{r('x')}</m:e></m:func>", "$\\sinx$"),
    (f"<m:acc><m:accPr><m:chr m:val='\u20d7'/></m:accPr><m:e>{r('v')}</m:e></m:acc>", "$\\vec{v}$"),
    (f"<m:m><m:mr><m:e>{r('1')}</m:e><m:e>{r('2')}</m:e></m:mr><m:mr><m:e>{r('3')}</m:e></m:mr></m:m>", "$\\begin{pmatrix} 1 & 2 \\\\ 3 \\end{pmatrix}$"),
    (f"<m:sPre><m:sub>{r('a')}</m:sub><m:sup>{r('b')}</m:sup><m:e>{r('X')}</m:e></m:sPre>", "${}_{a}^{b}X$"),
    (f"<m:rad><m:deg>{r('3')}</m:deg><m:e>{r('x')}</m:e></m:rad>", "$\\sqrt[3]{x}$"),
    (f"<m:bar><m:barPr><m:pos m:val='bot'/></m:barPr><m:e>{r('x')}</m:e></m:bar>", "$\\underline{x}$"),
]


def test_rules(spark):
    assert run(spark, [f"<m:oMath {M}>{x}</m:oMath>" for x, _ in CASES]) == [want for _, want in CASES]
    para = f"<m:oMathPara {M}><m:oMath>{r('a')}</m:oMath><m:oMath>{r('b')}</m:oMath></m:oMathPara>"
    assert run(spark, [para, None, "<broken", "", "plain", "<a></b>", "<a/><b/>", "<a>", "</a>", "<a/>x", f"<m:f {M}/>"]) == ["$$a \\\\ b$$", None, None, None, None, None, None, None, None, None, "$\\frac{}{}$"]


def test_what_xml_may_hold(spark):
    odd = f"""<?xml version="1.0"?><!-- a > b --><m:oMath {M}>
  <m:d><m:dPr><m:begChr m:val='>'/><m:endChr m:val="&lt;"/><m:sepChr m:val=""/></m:dPr><m:e><m:r><m:rPr><m:t>no</m:t></m:rPr><m:t>a&amp;b &#x3b1;&#946;<![CDATA[<c>]]></m:t></m:r> stray </m:e></m:d></m:oMath>"""
    assert run(spark, [odd]) == [plainly(odd)] and plainly(odd).startswith("$\\left> a&b")


TAGS = ["sSub", "sSup", "sSubSup", "f", "rad", "nary", "d", "func", "acc", "bar", "m", "eqArr", "limLow", "limUpp", "groupChr", "sPre", "box", "borderBox", "other", "r"]
INSIDE = ["e", "sub", "sup", "num", "den", "deg", "fName", "lim", "mr"]


def tree(rng, depth):
    tag = rng.choice(TAGS)
    if tag == "r" or depth > 4:
        return r(rng.choice(["x", " sin ", "α", "𝐀", "Log", "1 &lt; 2", ""]))
    sign = lambda: rng.choice([*OPERATORS, *ACCENTS, *DELIMITERS, "[", "⏞", "bot", "top", ""])
    props = "".join(f'<m:{p} m:val="{sign()}"/>' for p in ("chr", "begChr", "endChr", "sepChr", "pos") if rng.random() < 0.4)
    kids = "".join(f"<m:{k}>{''.join(f'<m:e>{tree(rng, depth + 1)}</m:e>' for _ in range(2)) if k == 'mr' else ''.join(tree(rng, depth + 1) for _ in range(rng.integers(0, 3)))}</m:{k}>" for k in rng.choice(INSIDE, rng.integers(1, 5)) if tag == "m" or k != "mr")
    return f"<m:{tag}><m:{tag}Pr>{props}</m:{tag}Pr>{kids}</m:{tag}>"


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, seed):
    rng = np.random.default_rng(seed)
    xmls = [f"<m:oMath {M}>{tree(rng, 0)}{tree(rng, 0)}</m:oMath>" for _ in range(120)]
    assert run(spark, xmls) == [plainly(x) for x in xmls]


def test_signs_that_no_xml_has(spark):
    assert run(spark, [f"<m:oMath {M}>{r(x)}</m:oMath>" for x in ("a\x02b", "a&#2;b", "a&#x41;", "<![CDATA[&#2;]]>")]) == [None, None, "$aA$", "$&#2;$"]


def test_many_rows_of_one_file_are_dealt_out(spark, tmp_path):
    from inkwell.plans import queries

    spark.createDataFrame([(k, k, f"b{k}") for k in range(40)], "p_partkey long, p_size int, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("omml_to_latex", "omml_families"):
        made = queries.queries()[name](spark, str(tmp_path))
        assert made.rdd.getNumPartitions() > 1 and made.where("latex LIKE '$%$'").count() == 40
