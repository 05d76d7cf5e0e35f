"""Entry file for ``spark-submit``."""

from framedrift.__main__ import main

if __name__ == "__main__":
    main()
