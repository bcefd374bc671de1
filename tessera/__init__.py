"""Evidence-grounded text analytics on Spark: named DataFrame operators over pinned corpora."""
