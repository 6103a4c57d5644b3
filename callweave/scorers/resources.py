"""What a model's stage asks of the cluster."""

from __future__ import annotations

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests


def gpu_profile(
    gpus_per_executor: int = 1,
    tasks_per_gpu: int = 1,
    cores_per_task: int = 1,
    memory: str | None = None,
    discovery_script: str = "",
) -> ResourceProfile:
    """Executors with GPUs, and a share of one for each task.

    Only the stage of the model runs on such executors, and Spark sets ``spark.task.resource.gpu`` aside for no other. The cluster
    manager must support stage-level scheduling; a local session does not, and there no profile is to be given.
    """
    executors = ExecutorResourceRequests().cores(gpus_per_executor * tasks_per_gpu * cores_per_task)
    executors = executors.resource("gpu", gpus_per_executor, discovery_script)
    if memory:
        executors = executors.memory(memory)
    tasks = TaskResourceRequests().cpus(cores_per_task).resource("gpu", 1 / tasks_per_gpu)
    return ResourceProfileBuilder().require(executors).require(tasks).build
