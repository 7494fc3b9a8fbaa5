"""Run the batch flow: ``spark-submit run_stages.py --input raw/ --output processed/`` (``--help`` for all options)."""

from folioflow.plans.stages import main

if __name__ == "__main__":
    main()
