import os

# one numpy thread for each Python worker, as on a cluster
os.environ.setdefault("OMP_NUM_THREADS", "1")
