import sys

from maskwright.cli import main

sys.exit(main())
