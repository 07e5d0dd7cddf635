"""Largest generated method per query (bytes); over 8000 the JVM does not compile it by default."""
import sys
sys.path.insert(0, __file__.rsplit("/", 2)[0])
from lodegrid.session import build_session
from lodegrid.catalog import load_all
from lodegrid.catalog.registry import QUERIES
load_all()
spark = build_session(8, spark__ui__showConsoleProgress="false", spark__sql__adaptive__enabled="false"); spark.sparkContext.setLogLevel("FATAL")
dbg = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
for n, f in QUERIES.items():
    if len(sys.argv) > 1 and n not in sys.argv[1:]: continue
    try:
        seq = dbg.codegenStringSeq(f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan())
        sizes = sorted((seq.apply(i)._3().maxMethodCodeSize() for i in range(seq.size())), reverse=True)
        if sizes and (sizes[0] > 8000 or -1 in sizes): print(n, sizes[:4], "fail" if -1 in sizes else "", flush=True)
    except Exception as e: print(n, "error", str(e)[:100])
