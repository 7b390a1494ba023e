"""python -m stratalog"""
import sys

from stratalog.cli import main

sys.exit(main())
