"""Largest generated methods of a query: python tools/codegen.py name [sf]."""
import sys
sys.path.insert(0, __file__.rsplit("/", 2)[0])
from lodegrid.session import build_session
from lodegrid.catalog import load_all
from lodegrid.catalog.registry import QUERIES
load_all()
spark = build_session(8, spark__ui__showConsoleProgress="false", spark__sql__adaptive__enabled="false"); spark.sparkContext.setLogLevel("FATAL")
df = QUERIES[sys.argv[1]](spark, f"/root/testdata/sf{(sys.argv + ['0.01'])[2]}")
qe = df._jdf.queryExecution()
seq = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(qe.executedPlan())
for i in range(seq.size()):
    t = seq.apply(i); st = t._3()
    if st.maxMethodCodeSize() < 0 or st.maxMethodCodeSize() > 8000:
        print("=====", i, st.maxMethodCodeSize(), "code chars", len(t._2())); print("\n".join(l[:150] for l in t._1().split("\n")[:int((sys.argv + ["", "", ""])[3] or 6)]))
