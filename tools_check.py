"""Run the local oracle comparison: python tools_check.py [sf_dir] [name ...]"""
import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))

if __name__ == "__main__":
    from hrlens.session import local_session
    from oracle_check import check
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = check(spark, sf, names)
    bad = [k for k, (ok, _) in res.items() if ok is False]
    print("BAD:", bad, f"{len(res) - len(bad)}/{len(res)} ok")
