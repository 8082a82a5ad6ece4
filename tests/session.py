import os

from quire.session import local_session


def make_session():
    cores = os.environ.get("BENCH_CPUS", "8")
    return local_session(cores, "8g", cores)
