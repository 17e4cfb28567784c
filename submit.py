"""Primary file for spark-submit: ``spark-submit --py-files dossierlens.zip submit.py DUMP DOCUMENTS OUT``."""

from dossierlens.__main__ import main

main()
