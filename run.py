"""Entry for ``spark-submit run.py`` and ``python run.py``: the batch job of the package."""

from companylens.__main__ import main

if __name__ == "__main__":
    main()
